from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models

from huntframe.llm.piece_model import parse_model, read_model
from huntframe.llm.token_counts import PieceCounter, count_tokens, op2_token_counts

MODEL = parse_model(read_model())
COUNTER = PieceCounter(read_model())
UNIGRAM = models.Unigram(list(zip(MODEL.pieces, map(float, MODEL.scores), strict=True)), 0, True)


def expected(text: str) -> int:
    return len(UNIGRAM.tokenize(COUNTER.normalised(text))) if text else 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeth  \n▁é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_equals_the_public_tokenizer(text):
    assert COUNTER.count(text) == expected(text)


def test_ties_keep_the_earliest_start():
    def size(n):
        return bytes([n])

    import struct

    def piece(text, score, kind=1):
        body = b"\x0a" + size(len(text.encode())) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + size(kind)
        return b"\x0a" + size(len(body)) + body

    data = piece("<unk>", 0, 2) + piece("a", -1) + piece("aa", -2) + piece("b", -3) + piece("ab", -4) + b"\x1a\x04\x18\x00\x20\x00"
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -3.0), ("ab", -4.0)]
    c, public = PieceCounter(data), models.Unigram(vocabulary, 0, False)
    for text in ["a", "aa", "aaa", "aaaa", "ab", "aab", "abab", "aaabb", "xya", "axyb", "xx"]:
        assert c.count(text) == len(public.tokenize(text)), text


def test_long_text_without_spaces_and_full_cache(monkeypatch):
    import huntframe.llm.token_counts as module

    monkeypatch.setattr(module, "CACHED_WORDS", 3)
    text = "ab cd ef gh ij " * 50 + "xyz" * 20000
    assert PieceCounter(read_model()).count(text) == expected(text)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, count_tokens(df).collect())) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert count_tokens(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op2_token_counts(spark, sf_dir).collect()} == {k: expected(t or "") for k, t in texts.items()}
