"""Keys of any name and type, and own columns that are named like an output."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from huntframe.llm import chat_format, grouped_prefix_join, piece_encoding, pii, quality, sharding, token_counts
from huntframe.llm.arrow_text import beside

ROWS = [("a", "write to me@example.com today"), ("b", None), (None, ""), ("a", "write to me@example.com today")]


def test_beside():
    assert beside("N_words", "n_words", "x") == ["n_words_", "x"]
    assert beside(["a", "a_"], "a", "A") == ["a__", "A___"]


@pytest.mark.parametrize(
    ("operator", "name"),
    [
        (token_counts.count_tokens, "n_tokens"), (token_counts.count_tokens, "a key"), (piece_encoding.encode_pieces, "ids"),
        (piece_encoding.encode_digests, "n_tokens"), (pii.detect_pii, "n_email"), (pii.detect_pii, "select"),
        (grouped_prefix_join.joined_documents, "digest"),
    ],
)
def test_keys_named_like_outputs(spark, operator, name):
    df = spark.createDataFrame(ROWS, ["id", "text"])
    plain = operator(df, key="id")
    other = operator(df.withColumnRenamed("id", name), key=name)
    assert len({c.lower() for c in other.columns}) == len(other.columns) == len(plain.columns)
    assert sorted(map(tuple, other.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert operator(df.limit(0), key="id").count() == 0


def test_leaders_by_a_key_named_digest(spark):
    df = spark.createDataFrame(ROWS, ["digest", "text"])
    kept = grouped_prefix_join.one_of_each(df, key="digest").collect()
    assert sorted(((r.digest, r.text) for r in kept), key=repr) == sorted({tuple(r) for r in ROWS}, key=repr)


def test_conversations_with_text_ids(spark):
    rows = [("x", 0, "user", "hi"), ("x", 1, "assistant", "</s> yes"), (None, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.parse_turns(chat_format.format_turns(turns))).collect()}
    assert set(got) == {"x", None} and got["x"].n_turns == 2 and got["x"].loss_chars == len("</s> yes")


def test_own_columns_stay(spark):
    df = spark.range(30).select("id", F.col("id").cast("string").alias("shard"), F.lit("mine").alias("slot"), (F.col("id") % 7).cast("int").alias("virtual_slot"))
    out = sharding.placed(df, sharding.first_map(spark, 4, 8).withColumn("rows", F.lit(0).cast("long")), ["id"])
    assert {(r.shard, r.slot) for r in out.collect()} == {(str(i), "mine") for i in range(30)}
    assert {"shard_", "slot_"} <= set(out.columns)
    texts = spark.createDataFrame(ROWS, ["id", "text"]).withColumn("text_len", F.lit(5)).withColumn("ref_url", F.lit("u"))
    metrics = quality.with_metrics(texts)
    judged = quality.with_verdict(metrics, quality.references(metrics))
    assert {"text_len", "ref_url", "text", "kept"} <= set(judged.columns) and judged.count() == len(ROWS)
