"""The training-data pipeline over ``documents``: each stage's result is written as Parquet and reread by the next one.

1. Quality rules reject documents by the base rule and by distribution divergence.
2. The n-gram Jaccard join keeps one document of each group: that of the smallest id.
3. Benchmark decontamination drops documents that share a window of words with an item.
4. Personal data, plain or disguised, is replaced by marks, and ``n_chars`` is counted anew.
5. SentencePiece encoding yields token counts and digests of what is left.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm import decontamination, grouped_prefix_join, piece_encoding, pii, quality
from huntframe.llm.storage import delete_since, mark, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Shingle length and similarity of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grouped_prefix_join.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact_texts(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(docs)


_first: int | None = None


def _stage(made: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stages before it: their results are written and reread, so nothing reads those."""

    @functools.wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _first
        if _first is not None:
            delete_since(spark, _first)
        _first = mark()
        return made(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(quality_rules)),
    ("near_duplicates", _stage(near_duplicates)),
    ("benchmark", _stage(benchmark)),
    ("personal_data", _stage(personal_data)),
    ("piece_encoding", _stage(encoding)),
]

#: SQL cannot express subword encoding; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, "corpus")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
