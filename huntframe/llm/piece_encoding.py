"""Offset-preserving SentencePiece encoding and decoding of whole texts.

Ids are those of the sentencepiece library. Each piece is projected to the span of source bytes it stands for: the text is
normalised by longest prefix through the model's compiled character map, which records the source position of
every byte made; the pieces' lengths then cut the normalised text, and the record leads back to the source. Without a map
normalisation only marks spaces, and the same projection is a running sum of the pieces' lengths.

Null texts count as empty: they have the end id alone, if one is asked for. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from huntframe.llm.arrow_text import keyed, map_rows
from huntframe.llm.piece_model import BYTE, CONTROL, SPACE, Normaliser, parse_model, read_model


class Encoder:
    def __init__(self, data: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.model = parse_model(data)
        self.normaliser = Normaliser(self.model)
        space = SPACE if self.model.escape_whitespaces else " "
        sizes, plain = [], []
        for piece, kind in zip(self.model.pieces, self.model.kinds, strict=True):
            one = 1 if kind == BYTE else 0 if kind == CONTROL else len(piece.encode())
            sizes.append(one)
            plain.append(one if kind in (BYTE, CONTROL) else len(piece.replace(space, " ").encode()))
        self.sizes, self.source_sizes = np.array(sizes), np.array(plain)
        self.unknown = self.lib.unk_id()

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in the text's UTF-8 bytes. Ids that only control have an empty span at the end."""
        data = text.encode()
        if self.normaliser.is_identity and SPACE not in text and self.unknown not in ids:
            ends = np.cumsum(self.source_sizes[ids]) - int(self.model.add_dummy_prefix) if ids else np.zeros(0, np.int64)
            ends = np.maximum(ends, 0) if data else np.zeros(len(ids), np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        else:
            made, source = self.normaliser.normalise(data)
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if self.unknown in ids:  # the length of an unknown piece is that of the text it stands for
                pieces = self.lib.encode(text, out_type=str)
                for i, (one, piece) in enumerate(zip(ids, pieces, strict=False)):
                    if one == self.unknown:
                        sizes[i] = len(piece.encode())
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            if cuts[-1] != len(made):
                raise ValueError("pieces do not cover the normalised text")
            at = np.array(source)[cuts]
            starts, ends = at[:-1], at[1:]
        if len(ends) and ends[-1] > len(data):
            raise ValueError("pieces do not cover the text")
        return starts, ends


@lru_cache(maxsize=2)
def encoder(data: bytes) -> Encoder:
    """One encoder per Python worker and model."""
    return Encoder(data)


def encode_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, add_end: bool = True
) -> DataFrame:
    """``key, ids, starts, ends, decoded``: ids of the whole text, each id's source byte span, and the decoded text.

    One narrow pass without a shuffle; each text is encoded alone, so a task holds one batch of texts and their ids.
    An empty table gives an empty one; an output that is named like the key gets a ``_`` at its end.
    """
    data = read_model(model_path)

    def rows(key, text):
        e = encoder(data)
        for k, t in zip(key, text, strict=True):
            ids = e.lib.encode(t or "", add_eos=add_end)
            starts, ends = e.spans(t or "", ids)
            yield k, ids, starts.tolist(), ends.tolist(), e.lib.decode(ids)

    longs = T.ArrayType(T.LongType())
    schema = keyed(df, key, ids=T.ArrayType(T.IntegerType()), starts=longs, ends=longs, decoded=T.StringType())
    return map_rows(df, {"key": key, "text": text}, schema, rows)


def encode_digests(
    df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str | None = None, add_end: bool = True
) -> DataFrame:
    """As ``encode_pieces``, reduced in the task to ``key, n_tokens, ids_sha256, decoded_sha256, spans_tile``.

    ``spans_tile`` says that the spans follow one another without a gap from the text's first byte to its last.
    """
    data = read_model(model_path)

    def rows(key, text):
        e = encoder(data)
        for k, t in zip(key, text, strict=True):
            t = t or ""
            ids = e.lib.encode(t, add_eos=add_end)
            starts, ends = e.spans(t, ids)
            tile = not len(ends) or bool(starts[0] == 0 and ends[-1] == len(t.encode()) and (starts[1:] == ends[:-1]).all())
            decoded = e.lib.decode(ids)
            yield (
                k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest(), tile,
            )

    schema = keyed(df, key, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType(), spans_tile=T.BooleanType())
    return map_rows(df, {"key": key, "text": text}, schema, rows)


def op7_piece_encoding(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
