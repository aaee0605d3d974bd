"""The live view as ``foreachBatch`` jobs: records in order, alerts once, rolling summary, newest rows.

All keep their state in ``versions`` tables, so a replayed micro-batch changes nothing. Each reads a batch once and merges small results into its
state: counts by key, ids in reach, or a bounded top of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import catalog
from ..operators import dashboard as D
from ..operators import realtime as RT
from .correlator import Correlator
from .versions import Versions

Job = Callable[[DataFrame, int], None]


def run_jobs(stream: DataFrame, checkpoint: str, *jobs: Job, **trigger) -> StreamingQuery:
    """Runs jobs over each micro-batch, one after the other. The batch is kept while several read it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist() if len(jobs) > 1 else batch
        try:
            for job in jobs:
                job(kept, batch_id)
        finally:
            if len(jobs) > 1:
                kept.unpersist()

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


class OrderedRelease:
    """Holds records back until their event time lies ``delay_seconds`` behind the newest one, and hands them on in record-id order.

    Records that arrive later than that go on with the next release. ``finish`` hands on what is left at the end of a bounded input. Records without
    a time are released at once.
    """

    def __init__(self, path: str, schema: T.StructType, job: Job, delay_seconds: int, record_id: str = "record_id", ts: str = "ts") -> None:
        self._held = Versions(f"{path}/held", T.StructType([*schema.fields, T.StructField("_newest", T.LongType())]))
        self._job, self._delay, self._id, self._ts = job, delay_seconds * 1_000_000, record_id, ts

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._release(batch, batch_id, self._delay)

    def finish(self, spark: SparkSession) -> None:
        numbers = self._held.numbers(spark)
        if numbers:
            held = self._held.read(spark, numbers[-1])
            self._release(held.drop("_newest").limit(0), numbers[-1] + 1, 0)

    def _release(self, batch: DataFrame, batch_id: int, delay: int) -> None:
        spark = batch.sparkSession
        t = F.unix_micros(F.col(self._ts))
        held = self._held.before(spark, batch_id)
        rows = held.unionByName(batch.withColumn("_newest", t))
        newest = rows.agg(F.max("_newest").alias("n")).first().n
        due = t.isNull() | (t <= F.lit((newest or 0) - delay))
        self._held.write(rows.where(~due).withColumn("_newest", F.lit(newest).cast("bigint")), batch_id)
        self._job(rows.where(due).drop("_newest").orderBy(self._id), batch_id)
        self._held.forget(spark, batch_id)


class LiveSummary:
    """Counts and latest times by code, technique, engine and severity, equal to ``dashboard.summary`` of everything seen."""

    def __init__(self, path: str) -> None:
        self._parts = Versions(f"{path}/summary", "metric string, key string, n bigint, latest string")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = batch.select(F.col("event.code").cast("string").alias("event_code"), RT.timestamp().alias("timestamp"))
        alerts = RT.realtime_alerts(batch).select(
            F.col("attack.technique.id").alias("technique_id"), F.col("detection.engine").alias("engine"), "severity", "timestamp"
        )
        both = self._parts.before(spark, batch_id).unionByName(D.summary_parts(events, alerts))
        self._parts.write(both.groupBy("metric", "key").agg(F.sum("n").alias("n"), F.max("latest").alias("latest")), batch_id)
        self._parts.forget(spark, batch_id)

    def rows(self, spark: SparkSession) -> DataFrame:
        return D.summary_rows(self._parts.before(spark))


class LatestRows:
    """The newest ``limit`` of some rows; rows without a time come last. A batch adds its own newest, never all its rows."""

    def __init__(self, path: str, schema: str, select: Callable[[DataFrame], DataFrame], limit: int, order: Sequence[Column]) -> None:
        self._top, self._select, self._limit, self._order = Versions(path, schema), select, limit, list(order)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = self._select(batch).orderBy(*self._order).limit(self._limit)
        both = self._top.before(spark, batch_id).unionByName(fresh.select(*self._top.schema.names))
        self._top.write(both.orderBy(*self._order).limit(self._limit), batch_id)
        self._top.forget(spark, batch_id)

    def rows(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        """The kept rows or the newest of them, in order."""
        return self._top.before(spark).orderBy(*self._order).limit(self._limit if limit is None else limit)


def latest_events(path: str, limit: int = catalog.REALTIME_EVENT_LIMIT) -> LatestRows:
    select = lambda b: b.select("seq", "ts", F.col("`@timestamp`").alias("timestamp"), F.col("event.code").cast("bigint").alias("event_code"))
    return LatestRows(
        f"{path}/latest-events", "seq bigint, ts timestamp, timestamp string, event_code bigint", select, limit, (F.desc_nulls_last("ts"), F.desc("seq"))
    )


def latest_alerts(path: str, limit: int = catalog.REALTIME_ALERT_LIMIT) -> LatestRows:
    """Of each alert id the first of a batch; ids that reach over batches are ``AlertLog``'s concern."""
    select = lambda b: RT.distinct_alerts(RT.realtime_alerts(b, keep=("seq", "ts"))).select("seq", "ts", "timestamp", F.col("rule.id").alias("rule_id"), "severity")
    return LatestRows(
        f"{path}/latest-alerts", "seq bigint, ts timestamp, timestamp string, rule_id string, severity string", select, limit,
        (F.desc_nulls_last("ts"), F.desc("seq"), F.asc("rule_id")),
    )


class AlertLog:
    """Alerts of the rules and the correlator, each id once: the first one wins.

    Ids are remembered until the newest event lies ``reach_seconds`` behind them. The log is append-only; documents of correlated alerts are joined
    by ids when they are read, so only ids pass through.
    """

    def __init__(self, path: str, correlator: Correlator, reach_seconds: int) -> None:
        self._correlator, self._reach = correlator, reach_seconds * 1_000_000
        self._seen = Versions(f"{path}/seen", "alert_id string, t bigint")
        self._log = Versions(f"{path}/log", "alert_id string, rule_id string, engine string, severity string, timestamp string, source_event_ids array<string>, t bigint")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._correlator(batch, batch_id)
        ruled = RT.distinct_alerts(RT.realtime_alerts(batch, keep=("ts",))).select(
            F.col("alert.id").alias("alert_id"), F.col("rule.id").alias("rule_id"), F.col("detection.engine").alias("engine"), "severity", "timestamp",
            F.array("source_id").alias("source_event_ids"), F.unix_micros("ts").alias("t"),
        )
        found = self._correlator.alerts(spark, batch_id).select(
            "alert_id", "rule_id", "engine", "severity", "timestamp", F.array("process_id", "network_id", "file_id").alias("source_event_ids"), "t"
        )
        seen = self._seen.before(spark, batch_id)
        fresh = ruled.unionByName(found).join(seen, "alert_id", "left_anti")
        logged = self._log.write(fresh, batch_id)
        ids = seen.unionByName(logged.select("alert_id", "t"))
        newest = ids.agg(F.max("t").alias("t")).first().t
        # an alert without a time is remembered for good: nothing tells when its id is out of reach
        self._seen.write(ids.where(F.col("t").isNull() | (F.col("t") >= F.lit((newest or 0) - self._reach))), batch_id)
        self._seen.forget(spark, batch_id)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return self._log.all(spark).drop("batch_id", "t")
