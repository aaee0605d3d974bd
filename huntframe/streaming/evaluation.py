"""Stateful stream form of the realtime evaluation: one state per labelled case, with timers.

Input rows are marker sightings (``kind = 'event'``) and alerts (``kind = 'alert'``) with their case columns.
There are only as many keys as cases, so a busy marker would put its whole batch into one group. Sightings
are therefore combined per short time slice inside the map tasks; the state machine only needs a slice's first
and last time and its count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import evaluate as V

# Workers get this module's classes by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MICROS = 1_000_000
#: Sightings of one slice belong to one episode (microseconds).
_SLICE = _MICROS
_STATE = (
    "status string, classification string, first_seen bigint, last_seen bigint, events bigint, alerts bigint, "
    "rules string, episode bigint, window bigint, expected boolean"
)
_OUTPUT = (
    "case_id string, episode bigint, status string, classification string, first_seen timestamp, "
    "last_seen timestamp, event_count bigint, alert_count bigint, actual_rule_ids string, kind string, slice bigint"
)


class _CaseTracker(StatefulProcessor):
    """Emits the state of an episode whenever it changes; the newest row per episode counts.

    Rows with a ``slice`` are no states: they say which episode the sightings or alerts (``kind``) of a time slice belong to. Their ids never pass
    through here, so neither the state nor a batch grows with them; see ``links``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("episode", _STATE)

    def _load(self):
        if not self._state.exists():
            return None
        names = [part.strip().split(" ")[0] for part in _STATE.split(",")]
        return dict(zip(names, self._state.get()))

    def _save(self, s: dict) -> None:
        self._state.update(tuple(s[p.strip().split(" ")[0]] for p in _STATE.split(",")))

    @staticmethod
    def _row(case_id: str, s: dict) -> tuple:
        return (
            case_id, s["episode"], s["status"], s["classification"], s["first_seen"], s["last_seen"], s["events"],
            s["alerts"], s["rules"], None, None,
        )

    @staticmethod
    def _expire(s: dict, now: int) -> bool:
        if s["status"] != "pending" or now - s["first_seen"] < s["window"]:
            return False
        s["status"] = "complete"
        s["classification"] = "false_negative" if s["expected"] else "true_negative"
        return True

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [part.strip().split(" ")[0] for part in _OUTPUT.split(",")]
        frame = pd.DataFrame(rows, columns=names)
        frame["slice"] = frame["slice"].astype("Int64")
        for c in ("first_seen", "last_seen"):
            frame[c] = pd.to_datetime(frame[c], unit="us")
        return frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["first_t", "kind_order"], kind="stable")
        case_id, s, out, places = key[0], self._load(), [], {}
        for r in batch.itertuples(index=False):
            first, last, window = int(r.first_t), int(r.last_t), int(r.window_seconds) * _MICROS
            if s is not None and self._expire(s, first):
                out.append(self._row(case_id, s))
            if r.kind == "event" and (s is None or (s["status"] == "complete" and first - s["last_seen"] > window)):
                s = {
                    "status": "pending", "classification": "", "first_seen": first, "last_seen": last,
                    "events": int(r.n), "alerts": 0, "rules": "", "episode": (s["episode"] if s else 0) + 1,
                    "window": window, "expected": bool(r.expected_alert),
                }
            elif r.kind == "event":
                s["events"] += int(r.n)
                s["last_seen"] = max(s["last_seen"], last)
            else:
                s = s or {
                    "status": "not_seen", "classification": "", "first_seen": first, "last_seen": last, "events": 0,
                    "alerts": 0, "rules": "", "episode": 1, "window": window, "expected": bool(r.expected_alert),
                }
                s["alerts"] += int(r.n)
                s["last_seen"] = max(s["last_seen"], last)
                s["rules"] = ",".join(sorted({*filter(None, s["rules"].split(",")), r.rule_id}))
                if s["expected"] and r.fits:
                    s["status"], s["classification"] = "complete", "true_positive"
                elif not s["expected"]:
                    s["status"], s["classification"] = "complete", "false_positive"
            out.append(self._row(case_id, s))
            places.setdefault((r.kind, first // _SLICE), s["episode"])
        if s["status"] == "pending":
            self._handle.registerTimer((s["first_seen"] + s["window"]) // 1000 + 1)
        self._save(s)
        # One row per episode: its newest state in this batch.
        placed = [(case_id, episode, *[None] * 7, kind, at) for (kind, at), episode in places.items()]
        yield self._frame([*{row[1]: row for row in out}.values(), *placed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        rows = []
        if s is not None and self._expire(s, expiredTimerInfo.getExpiryTimeInMs() * 1000):
            self._save(s)
            rows.append(self._row(key[0], s))
        yield self._frame(rows)

    def close(self) -> None:
        pass


def evaluation_input(sightings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sightings and alerts in the form the tracker reads, one row per sighting or alert that has a time."""
    rows = V.activity(sightings, alerts).where(F.col("ts").isNotNull())
    t = F.unix_micros("ts")
    return rows.select(
        "case_id", "expected_alert", "window_seconds", "ts", "kind", F.when(F.col("kind") == "event", 0).otherwise(1).alias("kind_order"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"), "fits", t.alias("first_t"), t.alias("last_t"), F.lit(1).cast("bigint").alias("n"),
    )


def link_ids(sightings: DataFrame, alerts: DataFrame) -> DataFrame:
    """The ids of sightings and alerts with their case and time slice; a stateless stream that is only appended to."""
    rows = V.activity(sightings, alerts).where(F.col("ts").isNotNull())
    return rows.select("case_id", "kind", F.floor(F.unix_micros("ts") / _SLICE).alias("slice"), "id", "rule_id")


def links(emitted: DataFrame, ids: DataFrame) -> DataFrame:
    """``case_id, episode, kind, id``: the ids of what belongs to each episode, from the tracker's slices and the appended ids."""
    places = emitted.where(F.col("slice").isNotNull()).groupBy("case_id", "kind", "slice").agg(F.min("episode").alias("episode"))
    return V.link_rows(ids.join(places, ["case_id", "kind", "slice"]))


_SLICED = (
    "case_id string, expected_alert boolean, window_seconds int, ts timestamp, kind string, kind_order int, "
    "rule_id string, fits boolean, first_t bigint, last_t bigint, n bigint"
)


def combine_in_tasks(rows: DataFrame) -> DataFrame:
    """Combines tracker rows per case, kind, rule and time slice inside each task, before the shuffle.

    A window shorter than the slice fails the run.
    """
    names = [part.strip().split(" ")[0] for part in _SLICED.split(",")]
    keys = ["case_id", "expected_alert", "window_seconds", "kind", "kind_order", "rule_id", "fits"]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (batch["window_seconds"] < _SLICE / _MICROS).any():
                raise ValueError("a case's window is shorter than a slice")
            batch["_slice"] = batch["first_t"] // _SLICE
            grouped = batch.groupby([*keys, "_slice"], as_index=False, sort=False).agg(
                first_t=("first_t", "min"), last_t=("last_t", "max"), n=("n", "sum"), ts=("ts", "max")
            )
            yield grouped[names]

    return rows.select(*names).mapInPandas(combine, _SLICED)


def track_cases(rows: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Episode states of a stream of tracker rows, as they change and as windows run out."""
    return (
        combine_in_tasks(rows)
        .withWatermark("ts", watermark)
        .groupBy("case_id")
        .transformWithStateInPandas(
            statefulProcessor=_CaseTracker(), outputStructType=_OUTPUT, outputMode="Update", timeMode="EventTime"
        )
    )


def newest_states(emitted: DataFrame) -> DataFrame:
    """The final row per case and episode of everything the tracker emitted."""
    done = F.when(F.col("status") == "complete", 1).otherwise(0)
    order = F.struct(F.col("event_count") + F.col("alert_count"), done, F.length("actual_rule_ids"))
    return (
        emitted.where(F.col("slice").isNull()).groupBy("case_id", "episode").agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")
    )
