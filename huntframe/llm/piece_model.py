"""What a SentencePiece model file holds, read from its bytes: pieces with scores and kinds, and the normaliser."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

SPACE = "▁"
# Kinds of pieces in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes. The driver reads it once and ships it with the tasks; such files are a few MB at most."""
    with open(path or default_model_path(), "rb") as f:
        return f.read()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Field number and value of each field of one encoded message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool
    space_as_suffix: bool


@lru_cache(maxsize=4)
def parse_model(data: bytes) -> PieceModel:
    pieces, scores, kinds = [], [], []
    flags = {3: 1, 4: 1, 5: 1}
    charsmap, suffix = b"", 0
    for number, value in _fields(data):
        if number == 1:
            one = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append(one[1].decode("utf-8"))
            scores.append(struct.unpack("<f", one[2])[0])
            kinds.append(one[3])
        elif number == 2:
            suffix = dict(_fields(value)).get(24, suffix)
        elif number == 3:
            spec = dict(_fields(value))
            charsmap = spec.pop(2, charsmap)
            flags |= {k: v for k, v in spec.items() if k in flags}
    return PieceModel(
        tuple(pieces), tuple(scores), tuple(kinds), charsmap, bool(flags[3]), bool(flags[4]), bool(flags[5]), bool(suffix)
    )


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose leaves point at replacement strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at ``at``."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, end + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Normaliser:
    """Longest-prefix normalisation that records, for each byte it makes, where the source stood."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        own = [p.encode() for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER_DEFINED]
        self.kept = sorted(own, key=len, reverse=True)

    @property
    def is_identity(self) -> bool:
        return not (self.map or self.kept or self.model.remove_extra_whitespaces or self.model.space_as_suffix)

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        for piece in self.kept:
            if data.startswith(piece, at):
                return piece, len(piece)
        if self.map and (found := self.map.longest(data, at)):
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    def normalise(self, data: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes and the source byte before which each of them was made, with one last entry for the end."""
        m, at, trim = self.model, 0, self.model.remove_extra_whitespaces
        space = SPACE.encode() if m.escape_whitespaces else b" "
        out, source = bytearray(), []

        def put(part: bytes, where: int) -> None:
            out.extend(part)
            source.extend([where] * len(part))

        while trim and at < len(data):
            part, size = self._next(data, at)
            if part != b" ":
                break
            at += size
        if at == len(data):
            return b"", [at]
        if m.add_dummy_prefix and not m.space_as_suffix:
            put(space, at)
        after_space = trim
        while at < len(data):
            part, size = self._next(data, at)
            if after_space:
                part = part.lstrip(b" ")
            if part:
                put(part.replace(b" ", space), at)
                after_space = trim and part.endswith(b" ")
            at += size
        end = at
        while trim and out.endswith(space):
            end = source[len(out) - len(space)]
            del out[-len(space) :], source[-len(space) :]
        if m.add_dummy_prefix and m.space_as_suffix:
            put(space, end)
        return bytes(out), [*source, end]
