from __future__ import annotations

import hashlib

import pytest
import sentencepiece

from huntframe.llm.piece_encoding import Encoder, encode_digests, encode_pieces, op7_piece_encoding
from huntframe.llm.piece_model import default_model_path, parse_model, read_model

TEXTS = ["", " ", "  a  b ", "Hello world", "x\n\ty\r\n", "漢字 \U0001f600 é", "▁ already", "</s> <s>", "a" * 3000, "ﬁne Ａ１ ™  x "]


def _with_map() -> bytes:
    """The public model with a character map, trimming and no byte fallback set by appended fields (later fields win)."""
    made = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    from huntframe.llm.piece_model import _fields

    charsmap = next(v for n, spec in _fields(made) if n == 3 for k, v in _fields(spec) if k == 2)

    def size(n):
        out = bytearray()
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    spec = b"\x12" + size(len(charsmap)) + charsmap + b"\x20\x01"
    return read_model() + b"\x1a" + size(len(spec)) + spec


def test_model_file_is_read():
    model = parse_model(read_model())
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    assert len(model.pieces) == lib.piece_size()
    assert all(model.pieces[i] == lib.id_to_piece(i) and model.scores[i] == lib.get_score(i) for i in range(0, 32000, 37))


@pytest.mark.parametrize("text", TEXTS)
def test_spans_project_to_the_source(text):
    e = Encoder(read_model())
    ids = e.lib.encode(text, add_eos=True)
    starts, ends = e.spans(text, ids)
    data = text.encode()
    assert list(starts[1:]) == list(ends[:-1]) and starts[0] == 0 and ends[-1] == len(data)
    pieces = e.lib.encode(text, out_type=str)
    for i, piece in enumerate(pieces):
        if not piece.startswith("<0x"):
            assert data[starts[i] : ends[i]].decode().replace(" ", "▁").lstrip("▁") == piece.lstrip("▁")


@pytest.mark.parametrize("text", TEXTS)
def test_character_map_equals_the_library(text):
    data = _with_map()
    e = Encoder(data)
    assert not e.normaliser.is_identity
    made, source = e.normaliser.normalise(text.encode())
    proto = e.lib.encode(text, return_type="proto")
    assert made.decode() == e.lib.normalize(text)
    ids = e.lib.encode(text)
    starts, ends = e.spans(text, ids)
    if not any(e.model.kinds[i] == 6 for i in ids):
        assert list(starts) == [p.begin for p in proto.pieces]
    assert len(source) == len(made) + 1 and source == sorted(source)


def test_frames(spark):
    df = spark.createDataFrame(
        [(1, None, "z"), (2, "a b", "z"), (2, "a b", "z"), (None, "", "z")], "doc_id long, text string, ids string"
    )
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    rows = sorted(map(tuple, encode_pieces(df).collect()), key=repr)
    ids = lib.encode("a b", add_eos=True)
    assert rows == sorted([(1, [2], [0], [0], ""), (None, [2], [0], [0], ""), *[(2, ids, [0, 1, 3], [1, 3, 3], "a b")] * 2], key=repr)
    assert encode_digests(df.limit(0)).count() == 0


def test_query_equals_the_library(spark, sf_dir):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), lib.decode(ids))]
        want.add((r.doc_id, len(ids), *digests, True))
    assert set(map(tuple, op7_piece_encoding(spark, sf_dir).collect())) == want
