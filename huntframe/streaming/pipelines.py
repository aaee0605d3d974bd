"""Streaming pipelines: record dedupe, stateless rules, consume-and-detect, drain helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..operators import alerts as A
from ..operators import envelope as E
from ..operators import realtime as RT

STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """State of any size on local disk with checkpoints in the shared folder; the trackers need it when they start.

    The caller owns the session: the store, and the number of state partitions if one is given, hold inside the block
    only, and the session's settings are put back after it.
    """
    wanted = {STATE_STORE_CONF: ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def distinct_records(records: DataFrame, key: str = "record_id", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Each record id once, however often a poll delivers it inside the watermark."""
    return records.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def detect_stream(events: DataFrame, as_of: str | None = None) -> DataFrame:
    """Realtime alerts of a stream; stateless."""
    return RT.realtime_alerts(events, as_of)


def consume_and_detect(
    messages: DataFrame, engine: str = "all", created_at: str | None = None, fail_fast: bool = True
) -> DataFrame:
    """Topic messages to alerts. Bad messages fail the run, or are skipped to the dead letters."""
    parsed = E.parse_envelopes(messages)
    return A.run_engines(E.valid_events(parsed, fail_fast), engine, created_at)


def drain(stream: DataFrame, label: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Runs a stream over all available input into a table in the shared folder and reads it back."""
    spark = stream.sparkSession
    target = session.scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", session.scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def drain_batches(stream: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Like ``drain`` for update and complete output: each micro-batch is kept with its number."""
    spark = stream.sparkSession
    target = session.scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Keyed by batch number, so a replayed batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", session.scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", target).parquet(target)


def series(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Event counts per time window and code for a dashboard series (``ts`` and ``event_code`` columns)."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), "event_code")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_code", "n")
    )
