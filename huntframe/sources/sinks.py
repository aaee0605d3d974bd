"""Sinks: idempotent daily tables, topics, JSON lines and snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import catalog
from ..functions import ids
from ..session import delete_path
from .readers import path_exists

MAX_DAYS = 10_000
#: Up to so many ids are sent to the tasks that read documents; with more, documents are shuffled to meet by id.
FEW_IDS = 100_000


def upsert_daily(df: DataFrame, path: str, doc_id: Column, index_date: Column, order: Column | None = None) -> None:
    """Writes documents by id into the partitions of their day; the same id replaces itself.

    Touched days are read back, merged and rewritten in one dynamic partition overwrite, which a
    retried or lost task cannot leave half done. The batch is first written beside the table, compressed, and read from there: for its days, a few values
    that select the partitions to read (above ``MAX_DAYS`` by a join), for its ids, and for its rows. Ids are compared by 128-bit digests of day and id, and
    documents stay where they are read unless very many ids repeat within the batch, or many are replaced while many stay. Other days are neither
    read nor written; rows without a day have
    a partition of their own. A replayed batch gives the same table. Within a batch the last document by ``order`` wins, among equals the one of
    the largest content digest. A document without an id has that digest as its id, so different ones stay apart. Columns named like
    the table's own fail the call.
    """
    own = {"_doc_id", "index_date", "_new"} & set(df.columns)
    if own:
        raise ValueError(f"rename these columns, which the table uses itself: {sorted(own)}")
    spark = df.sparkSession
    rank = order if order is not None else F.lit(0)
    fresh = df.withColumns(
        {
            "_doc_id": F.coalesce(doc_id, F.concat(F.lit("content-"), _content(df.columns))), "index_date": index_date,
            "_new": F.struct(F.lit(1).alias("fresh"), rank.alias("rank")),
        }
    )
    name = path.rstrip("/").rpartition("/")[2]
    batch = f"{path.rstrip('/').removesuffix(name)}_{name}-batch-{uuid.uuid4().hex}"
    try:
        fresh.write.option("compression", "zstd").parquet(batch)
        _merge_days(spark, spark.read.schema(fresh.schema).parquet(batch), path)
    finally:
        delete_path(spark, batch)


def _content(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)


def _merge_days(spark: SparkSession, fresh: DataFrame, path: str) -> None:
    stored = None
    days = [r.index_date for r in fresh.select("index_date").distinct().limit(MAX_DAYS + 1).collect()]
    if path_exists(spark, path):
        stored = spark.read.parquet(path)
        if len(days) > MAX_DAYS:
            every = fresh.select(F.col("index_date").alias("_day")).distinct()
            stored = stored.join(every, F.col("index_date").eqNullSafe(F.col("_day")), "left_semi")
        else:
            touched = F.col("index_date").isin([d for d in days if d is not None])
            if None in days:
                touched = touched | F.col("index_date").isNull()
            stored = stored.where(touched)
    rows = merged_days(fresh, stored)
    if len(days) == 1:
        # Rows of several days are sorted by day to be written; those of one need not be, if the plan shows it.
        rows = rows.withColumn("index_date", F.lit(days[0]).cast(rows.schema["index_date"].dataType))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_date").parquet(path)


def merged_days(fresh: DataFrame, stored: DataFrame | None) -> DataFrame:
    """One row per day and id: of the batch (``_new`` holds ``fresh`` and ``rank``), else of what is stored for its days."""
    key = F.substring(F.unhex(F.sha2(F.to_json(F.struct(F.col("index_date").cast("string").alias("d"), F.col("_doc_id").alias("i"))), 256)), 1, 16)
    ids = fresh.select(key.alias("_key"), F.lit(1).alias("new"))
    rows = fresh
    if stored is not None:
        ids = ids.unionByName(stored.select(key.alias("_key"), F.lit(0).alias("new")))
        none = F.struct(F.lit(0).alias("fresh"), F.lit(None).cast(fresh.schema["_new"].dataType["rank"].dataType).alias("rank"))
        stored = stored.withColumn("_new", none)
        rows = stored.unionByName(fresh, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in ("_doc_id", "index_date", "_new")]

    counts = ids.groupBy("_key").agg(F.sum("new").alias("new"), F.count("*").alias("n"))
    kept, lost = F.col("new") == 0, (F.col("new") > 0) & (F.col("new") < F.col("n"))
    repeated = (F.col("new") > 1) | (kept & (F.col("n") > 1))
    sizes = counts.agg(F.count_if(repeated).alias("repeated"), F.count_if(kept).alias("kept"), F.count_if(lost).alias("lost")).first()
    out = lambda df: df.select("_doc_id", *[F.col(f"`{c}`") for c in columns], "index_date")

    def by_id(df: DataFrame) -> DataFrame:
        # Grouping by day and id spreads a busy day over many tasks by id.
        last = df.withColumn("_new", F.struct("_new.fresh", "_new.rank", _content(columns).alias("digest")))
        merged = last.groupBy("index_date", "_doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col("_new")).alias("_row"))
        return merged.select("_doc_id", "_row.*", "index_date")

    def listed(df: DataFrame, which: Column, how: str) -> DataFrame:
        few = counts.where(which).select("_key")
        return df.join(F.broadcast(few), key == few["_key"], how)

    if sizes.repeated > FEW_IDS or min(sizes.kept, sizes.lost) > FEW_IDS:
        return by_id(rows)
    if stored is not None:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        if sizes.kept == 0 and all(kinds[f.name] == f.dataType.simpleString() for f in fresh.schema):
            # The batch alone, in the table's columns: no union, which would hide that all its rows have one day.
            rows = fresh.select(*[F.col(f"`{c}`") if c in fresh.columns else F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns])
        else:
            if sizes.kept == 0:
                stored = stored.where(F.lit(False))
            elif sizes.lost:
                stored = listed(stored, kept, "left_semi") if sizes.kept <= sizes.lost else listed(stored, lost, "left_anti")
            rows = stored.unionByName(fresh, allowMissingColumns=True)
    if not sizes.repeated:
        return out(rows)
    return out(listed(rows, repeated, "left_anti")).unionByName(by_id(listed(rows, repeated, "left_semi")))


def write_events(events: DataFrame, path: str, index_date: Column) -> None:
    upsert_daily(events, path, ids.event_document_id(), index_date)


def write_alerts(alerts: DataFrame, path: str, index_date: Column) -> None:
    upsert_daily(alerts, path, F.col("alert.id"), index_date)


def write_responses(responses: DataFrame, path: str, index_date: Column) -> None:
    upsert_daily(responses, path, F.col("response.id"), index_date)


def write_protection(records: DataFrame, path: str, index_date: Column) -> None:
    upsert_daily(records, path, F.col("protection.id"), index_date)


def write_messages(serialized: DataFrame, servers: str, topic: str = catalog.EVENTS_TOPIC) -> None:
    serialized.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_message_files(serialized: DataFrame, path: str) -> None:
    """The topic's offline stand-in: one serialized envelope per line."""
    serialized.select("value").write.mode("append").text(path)


def stream_upserts(stream: DataFrame, path: str, doc_id: Column, index_date: Column, checkpoint: str, **trigger) -> StreamingQuery:
    """Daily upserts of a stream; replayed micro-batches leave the table as it was."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        upsert_daily(batch, path, doc_id, index_date)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_json_lines(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        stream.writeStream.format("json")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def stream_daily_raw(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends posted raw rows (``index_date`` column) to daily partitions."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("index_date")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def write_snapshots(snapshots: dict[str, DataFrame], base: str) -> None:
    """Overwrites the named snapshot tables."""
    for name, df in snapshots.items():
        df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")
