"""End-to-end batch plans: raw telemetry to alerts, and the labelled case matrix."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ANOMALY_RULE, ANOMALY_THRESHOLD, DEFAULT_BASELINE, DEFAULT_PLAYBOOKS, Baseline, Playbook
from ..operators import alerts as A
from ..operators import anomaly as M
from ..operators import evaluate as V
from ..operators import normalize as N
from ..operators import response as P
from ..operators import rules as R
from ..operators import sequences as Q


def telemetry_to_alerts(
    documents: DataFrame, engine: str = "all", created_at: str | dt.datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw event documents (``xml``) to alerts and dead letters; no shuffle on the way to the alerts."""
    good, rejects = N.split_rejects(N.normalize_xml(documents))
    # Detection does not need the original document.
    slim = good.withColumn("event", F.col("event").withField("original", F.lit(None).cast("string")))
    return A.run_engines(slim, engine, created_at), rejects


_SINGLE = R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES)
#: Technique of each rule; an anomaly alert has none.
_TECHNIQUES = {r.rule_id: r.technique_id for r in (*_SINGLE, *Q.SEQUENCES)}


def case_facts(
    cases: DataFrame,
    events: DataFrame,
    order: str = "seq",
    baseline: Baseline = DEFAULT_BASELINE,
    playbooks: Sequence[Playbook] = DEFAULT_PLAYBOOKS,
    window_seconds: int | None = None,
) -> DataFrame:
    """What the engines find over the events of all cases, as the rows ``evaluate.case_rows_of`` reads.

    One pass over the events tags each with its case's engine and yields its event, its rule hits, its anomaly and its failure in one
    generator; only the behavioural cases' events are read again, for their sequences. ``all`` stands for native and Sigma-like. An event that its
    case's engine cannot take is a failure, a dead letter of the same plan.
    """
    tagged = events.join(cases.select("case_id", F.col("engine").alias("case_engine")), "case_id")
    prepared = M.with_scores(M.with_features(R.prepare(tagged), on_reject="keep"), baseline, ANOMALY_THRESHOLD)
    runs = lambda *engines: F.col("case_engine").isin(*engines)
    names = ("kind", "event_code", "rule_id", "engine", "error")

    def fact(when: Column, kind: str, **values: Column) -> Column:
        given = {"kind": F.lit(kind), **values}
        return F.when(when, F.struct(*[given.get(n, F.lit(None)).cast("string").alias(n) for n in names]))

    own = {"native": ("native", "all"), "sigma-like": ("sigma-like", "all")}
    anomaly = runs("ml-anomaly")
    found = F.array(
        fact(F.lit(True), "event", event_code=F.col("event.code")),
        *[
            fact(runs(*own[r.engine]) & (F.size(R.matched_fields(r)) > 0), "alert", rule_id=F.lit(r.rule_id), engine=F.lit(r.engine))
            for r in _SINGLE
        ],
        fact(anomaly & F.col("feature_error").isNull() & F.col("is_anomaly"), "alert", rule_id=F.lit(ANOMALY_RULE["id"]), engine=F.lit("ml-anomaly")),
        fact(anomaly & F.col("feature_error").isNotNull(), "failure", error=F.col("feature_error")),
    )
    single = prepared.select("case_id", F.col(order).cast("bigint").alias("ord"), F.explode(F.array_compact(found)).alias("f")).select(
        "case_id", "ord", "f.*", F.lit(None).cast("string").alias("sequence_name")
    )
    behavioral = tagged.where(runs("behavioral"))
    sequences = Q.behavioral_alerts(behavioral, window_seconds=window_seconds, key=order, order=order, scope="case_id").select(
        "case_id", F.lit(None).cast("bigint").alias("ord"), F.lit("alert").alias("kind"), F.lit(None).cast("string").alias("event_code"),
        F.col("rule.id").alias("rule_id"), F.lit("behavioral").alias("engine"), F.lit(None).cast("string").alias("error"),
        F.col("detection.sequence_name").alias("sequence_name"),
    )
    rows = single.unionByName(sequences)
    technique = F.element_at(F.create_map(*[F.lit(x) for pair in _TECHNIQUES.items() for x in pair]), F.col("rule_id"))
    planned = (F.col("kind") == "alert") & P.is_planned(F.col("rule_id"), technique, playbooks)
    kinds = F.array_compact(F.array(F.col("kind"), F.when(planned, F.lit("response"))))
    return rows.withColumn("kind", F.explode(kinds)).select(
        "case_id", "kind", "ord", F.lit(1).cast("bigint").alias("n"), "event_code", "rule_id", "engine", "sequence_name", "error"
    )


def run_case_matrix(cases: DataFrame, events: DataFrame, **options) -> DataFrame:
    """The case matrix: all engines run once over the events of all cases; ``options`` as in ``case_facts``.

    ``cases``: the catalogue with ``case_id, engine, expected_alert`` and more; ``events``: normalized events with ``case_id``.
    """
    return V.case_rows_of(cases, case_facts(cases, events, **options))
