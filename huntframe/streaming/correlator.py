"""Stream form of the process, network, file correlator: each micro-batch is correlated as a distributed job.

State is two tables (see ``versions``): the step events that later arrivals can still reach, and the triples already emitted with them. A
micro-batch's arrivals look up the step events of both, as in the batch form, so no row is scanned per arrival and no
task holds a key's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import catalog, session
from ..operators import realtime as RT
from .versions import Versions

_MICROS = 1_000_000
_IDS = [f"{s}_id" for s in RT.STEPS]
_STEPS = "key string, eid string, stamp string, o bigint, step string, t bigint"
_TRIOS = "process_id string, network_id string, file_id string, timestamp string, t bigint"


class Correlator:
    """A ``foreachBatch`` function; ``alerts`` reads what it has found.

    Step events stay in reach until the newest one lies more than the window and ``delay_seconds`` behind them. Later arrivals still fire, but find
    only what is in reach.
    """

    def __init__(
        self,
        path: str,
        window_seconds: int = catalog.REALTIME_WINDOW_SECONDS,
        delay_seconds: int = 300,
        order: str = "seq",
        host_scoped: bool = False,
    ) -> None:
        self._window, self._order, self._host_scoped = window_seconds, order, host_scoped
        self._reach = (window_seconds + delay_seconds) * _MICROS
        self._arrived = Versions(f"{path}/arrived", _STEPS)
        self._steps = Versions(f"{path}/steps", _STEPS)
        self._emitted = Versions(f"{path}/emitted", _TRIOS)
        self._found = Versions(f"{path}/found", _TRIOS)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = RT.correlation_input(batch, self._order, self._host_scoped).withColumn("t", F.unix_micros("ts"))
        known = self._steps.before(spark, batch_id)
        steps = self._arrived.write(rows.where("step IS NOT NULL").select(*known.columns).unionByName(known), batch_id)
        emitted = self._emitted.before(spark, batch_id)
        trios = RT.correlated_trios(rows, steps, self._window)
        found = self._found.write(trios.join(emitted, _IDS, "left_anti"), batch_id)
        newest = steps.agg(F.max("t").alias("t")).first().t
        reached = F.col("t") >= F.lit((newest or 0) - self._reach)
        self._steps.write(steps.where(reached), batch_id)
        self._emitted.write(emitted.unionByName(found).where(reached), batch_id)
        for state in (self._arrived, self._steps, self._emitted):
            state.forget(spark, batch_id)

    def alerts(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """Alert rows of all triples found so far, each once, or of one micro-batch."""
        found = self._found.all(spark).drop("batch_id") if batch_id is None else self._found.read(spark, batch_id)
        return RT.behavioral_alerts(found)


def correlate_stream(events: DataFrame, correlator: Correlator, checkpoint: str, **trigger) -> StreamingQuery:
    """Feeds a stream of normalized events to a correlator. Keys are not scoped to a host unless the correlator says so."""
    return (
        events.writeStream.foreachBatch(correlator)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain_correlation(events: DataFrame, window_seconds: int = catalog.REALTIME_WINDOW_SECONDS, delay_seconds: int = 300, **options) -> DataFrame:
    """Runs a stream over all available input and returns the alert rows."""
    spark = events.sparkSession
    correlator = Correlator(session.scratch_path(spark, "correlator"), window_seconds, delay_seconds, **options)
    correlate_stream(events, correlator, session.scratch_path(spark, "correlator-checkpoint")).awaitTermination()
    return correlator.alerts(spark)
