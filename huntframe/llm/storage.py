"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a local session (tests) may go without that setting."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="huntframe-llm-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_made: list[str] = []


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a table once and reads it back: later steps don't recompute it, and lost executors don't lose it. The path serves ``delete``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    return written_at(df, label)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _made:
        _made.remove(path)


def mark() -> int:
    """A point in the order of written tables."""
    return len(_made)


def delete_since(spark: SparkSession, point: int, keep: str | None = None) -> None:
    """Deletes what was written after ``point``, but for the table at ``keep``."""
    for path in [p for p in _made[point:] if p != keep]:
        delete(spark, path)
