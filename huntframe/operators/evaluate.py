"""Expected-versus-actual evaluation: case actuals, classification, episodes of realtime markers.

Case tables are labelled catalogues. Alerts and events are reduced per case and value before anything
is gathered into an array, so arrays hold distinct rule ids, engines or names and never alerts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import EvaluationCase
from ..functions import scalars as S
from ..session import cut_lineage

CLASSES = ("true_positive", "true_negative", "false_positive", "false_negative")


def classify(expected: Column, actual: Column) -> Column:
    return (
        F.when(expected & actual, F.lit("true_positive"))
        .when(~expected & ~actual, F.lit("true_negative"))
        .when(~expected & actual, F.lit("false_positive"))
        .otherwise(F.lit("false_negative"))
    )


def classification_counts(rows: DataFrame, column: str = "classification") -> DataFrame:
    """One row with the four ``<class>_count`` columns."""
    return rows.agg(*[F.count_if(F.col(column) == c).alias(f"{c}_count") for c in CLASSES])


def first_seen_values(rows: DataFrame, by: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """Distinct non-empty values per group, in the order they were first seen.

    Values are reduced to one row each before the array is built.
    """
    firsts = rows.where(S.text(F.col(value)) != "").groupBy(*by, value).agg(F.min(order).alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("v"))))
    return firsts.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def case_rows(cases: DataFrame, alerts: DataFrame, events: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """One row per case with what its alerts, events and responses amount to.

    ``alerts``: ``case_id, ord, rule_id, engine, sequence_name``; ``events``: ``case_id, ord, event_code``;
    ``responses``: ``case_id``. Engines default to native.
    """
    a = alerts.withColumn("engine", F.coalesce(S.non_empty(F.col("engine")), F.lit("native")))
    # One pass over the alerts per case and value; the long arrays never form.
    per_value = a.groupBy("case_id", "rule_id", "engine", "sequence_name").agg(
        F.count("*").alias("n"), F.min("ord").alias("first")
    )
    ordered = lambda c: F.array_distinct(
        F.transform(
            F.array_sort(F.collect_list(F.when(S.text(F.col(c)) != "", F.struct("first", F.col(c).alias("v"))))),
            lambda s: s["v"],
        )
    )
    actuals = per_value.groupBy("case_id").agg(
        F.sum("n").alias("alert_count"),
        F.sum(F.when(F.col("engine") == "behavioral", F.col("n")).otherwise(0)).alias("correlated_sequence_count"),
        ordered("rule_id").alias("actual_rule_ids"),
        ordered("engine").alias("actual_engines"),
        ordered("sequence_name").alias("actual_sequence_names"),
    )
    codes = first_seen_values(
        events.withColumn("event_code", F.col("event_code").cast("string")), ["case_id"], "event_code", "ord", "_codes"
    ).select("case_id", F.array_join("_codes", "/").alias("event_code"))
    counts = events.groupBy("case_id").agg(F.count("*").alias("normalized_event_count"))
    df = cases.join(actuals, "case_id", "left").join(codes, "case_id", "left").join(counts, "case_id", "left")
    if responses is not None:
        df = df.join(responses.groupBy("case_id").agg(F.count("*").alias("response_count")), "case_id", "left")
    else:
        df = df.withColumn("response_count", F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    for c in ("alert_count", "correlated_sequence_count", "normalized_event_count", "response_count"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast("bigint")))
    for c in ("actual_rule_ids", "actual_engines", "actual_sequence_names"):
        df = df.withColumn(c, F.coalesce(F.col(c), none))
    df = df.withColumn("actual_alert", F.col("alert_count") > 0)
    return df.withColumn("classification", classify(F.col("expected_alert"), F.col("actual_alert")))


def case_rows_of(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per case from one aggregate over its facts.

    ``facts``: ``case_id, kind, ord, n, event_code, rule_id, engine, sequence_name, error``, one row per event, alert, planned response or failure
    (``kind``), or several of them counted in ``n``.

    A case with a failure keeps its row with ``status`` failed, its first error in order, and nothing counted. Arrays hold distinct values in the order
    of their first fact, which are combined before anything is gathered.
    """
    values = ("event_code", "rule_id", "engine", "sequence_name", "error")
    combined = facts.groupBy("case_id", "kind", *values).agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("bigint"))
    is_kind = lambda k: F.col("kind") == k
    listed = lambda kind, c: F.array_distinct(
        F.transform(
            F.array_sort(F.collect_list(F.when(is_kind(kind) & (S.text(F.col(c)) != ""), F.struct("ord", F.col(c).alias("v"))))), lambda s: s["v"]
        )
    )
    one = combined.groupBy("case_id").agg(
        count(is_kind("alert")).alias("alert_count"),
        count(is_kind("alert") & (F.col("engine") == "behavioral")).alias("correlated_sequence_count"),
        count(is_kind("response")).alias("response_count"),
        count(is_kind("event")).alias("normalized_event_count"),
        listed("alert", "rule_id").alias("actual_rule_ids"),
        listed("alert", "engine").alias("actual_engines"),
        listed("alert", "sequence_name").alias("actual_sequence_names"),
        F.array_join(listed("event", "event_code"), "/").alias("event_code"),
        F.min_by("error", F.when(is_kind("failure"), F.col("ord"))).alias("error"),
    )
    df = cases.join(one, "case_id", "left").withColumn("_ok", F.col("error").isNull())
    for c in ("alert_count", "correlated_sequence_count", "response_count", "normalized_event_count"):
        df = df.withColumn(c, F.coalesce(F.when(F.col("_ok"), F.col(c)), F.lit(0).cast("bigint")))
    for c in ("actual_rule_ids", "actual_engines", "actual_sequence_names"):
        df = df.withColumn(c, F.coalesce(F.when(F.col("_ok"), F.col(c)), F.array().cast("array<string>")))
    df = df.withColumns(
        {
            "event_code": F.when(F.col("_ok"), F.col("event_code")),
            "status": F.when(F.col("_ok"), F.lit("passed")).otherwise(F.lit("failed")),
            "actual_alert": F.col("alert_count") > 0,
        }
    )
    return df.withColumn("classification", classify(F.col("expected_alert"), F.col("actual_alert"))).drop("_ok")


def with_failures(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Adds ``status`` and ``error``; cases that failed (``case_id, error``) keep their row."""
    df = rows.join(failures.select("case_id", "error"), "case_id", "left")
    return df.withColumn("status", F.when(F.col("error").isNull(), F.lit("passed")).otherwise(F.lit("failed")))


def select_cases(cases: DataFrame, case_ids: Sequence[str] | None = None, include_failures: bool = True) -> DataFrame:
    df = cases if case_ids is None else cases.where(F.col("case_id").isin(*case_ids))
    return df if include_failures or "status" not in cases.columns else df.where(F.col("status") == "passed")


def unknown_case_ids(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted case ids the catalogue does not have."""
    return wanted.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti")


def count_map(rows: DataFrame, key: Column, metric: str, n: Column | None = None) -> DataFrame:
    """``metric, key, n`` rows: how often each key occurs, or the sum of ``n`` per key."""
    total = F.count("*") if n is None else F.sum(n)
    return rows.groupBy(key.alias("key")).agg(total.cast("bigint").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")


def dashboard_counts(rows: DataFrame) -> DataFrame:
    """All dashboard count maps of a case matrix as one long table of ``metric, key, n``.

    Every case contributes its rows to each map in one ``explode``, so the matrix is read and
    shuffled once.
    """
    entry = lambda m, k, n=None: F.struct(
        F.lit(m).alias("metric"), k.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("bigint").alias("n")
    )
    each = lambda m, c: F.transform(F.col(c), lambda v: entry(m, v))
    protection = F.coalesce(S.non_empty(F.col("expected_protection")), F.lit("none"))
    technique_hit = F.col("actual_alert") & (S.text(F.col("technique_id")) != "")
    single = F.array(
        entry("protection_count", protection),
        F.when(technique_hit, entry("alert_count_by_technique", F.col("technique_id"), F.col("alert_count"))),
        F.when(F.col("event_code").isNotNull(), entry("event_count_by_code", F.col("event_code"))),
        entry("classification", F.col("classification")),
        entry("total", F.lit("response_count"), F.col("response_count")),
        entry("total", F.lit("correlated_sequence_count"), F.col("correlated_sequence_count")),
    )
    entries = F.concat(
        F.array_compact(single),
        each("alert_count_by_rule", "actual_rule_ids"),
        each("alert_count_by_engine", "actual_engines"),
        each("sequence_count_by_name", "actual_sequence_names"),
    )
    return (
        rows.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.metric").alias("metric"), F.col("e.key").alias("key"))
        .agg(F.sum("e.n").alias("n"))
    )


def case_violations(cases: DataFrame) -> DataFrame:
    """Quality checks over a batch case catalogue: one row per violated check."""
    bad = lambda c, allowed: F.when(~S.text(F.col(c)).isin(*allowed), F.lit(f"bad:{c}"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = F.array(
        F.when(S.text(F.col("case_id")) == "", F.lit("missing:case_id")),
        bad("category", catalog.CASE_CATEGORIES),
        bad("input_type", catalog.CASE_INPUT_TYPES),
        bad("engine", catalog.CASE_ENGINES),
        bad("expected_protection", catalog.CASE_PROTECTIONS),
        bad("runner_mode", catalog.CASE_RUNNER_MODES),
        F.when(
            (F.col("category") == "attack") & F.col("expected_alert")
            & (size("expected_engines") <= 0) & (size("expected_rule_ids") <= 0),
            F.lit("missing:expectation"),
        ),
        F.when(F.col("expected_protection") == "execute-lab-only", F.lit("unsupported:execute-lab-only")),
    )
    per_case = cases.select("case_id", F.explode(F.array_compact(checks)).alias("violation"))
    repeated = cases.groupBy("case_id").count().where("count > 1")
    return per_case.unionByName(repeated.select("case_id", F.lit("duplicate:case_id").alias("violation")))


def rule_id_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual rule ids per case.

    ``expected``: ``case_id, rule_id, expected_count``; ``actual``: ``case_id, rule_id``. A case passes if all its
    expected rules fired and the alert count is the expected one.
    """
    # Read twice below, and small next to the alerts it counts.
    fired = cut_lineage(actual.groupBy("case_id", "rule_id").agg(F.count("*").alias("n")))
    totals = fired.groupBy("case_id").agg(F.sum("n").alias("actual_alert_count"))
    wanted = expected.groupBy("case_id").agg(F.max("expected_count").alias("expected_alert_count"))
    missing = (
        expected.select("case_id", "rule_id")
        .join(fired.select("case_id", "rule_id"), ["case_id", "rule_id"], "left_anti")
        .groupBy("case_id")
        .agg(F.count("*").alias("missing_rule_count"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        wanted.join(totals, "case_id", "left")
        .join(missing, "case_id", "left")
        .select(
            "case_id",
            "expected_alert_count",
            F.coalesce("actual_alert_count", zero).alias("actual_alert_count"),
            F.coalesce("missing_rule_count", zero).alias("missing_rule_count"),
        )
        .withColumn(
            "passed",
            (F.col("missing_rule_count") == 0) & (F.col("actual_alert_count") == F.col("expected_alert_count")),
        )
    )


def containment_checks(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Per check whether all its required rules fired: ``name, required_count, missing_count, actual_alert_count, passed``.

    ``required``: ``name, rule_id``; ``actual``: ``name, rule_id, n``, the alerts per rule. Rules that fired but are not required only count as alerts.
    """
    both = required.select("name", "rule_id").distinct().withColumn("needed", F.lit(True)).join(
        actual.groupBy("name", "rule_id").agg(F.sum("n").alias("n")), ["name", "rule_id"], "full"
    )
    needed = F.coalesce(F.col("needed"), F.lit(False))
    checks = both.groupBy("name").agg(
        F.count_if(needed).alias("required_count"), F.count_if(needed & F.col("n").isNull()).alias("missing_count"),
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("actual_alert_count"),
    )
    return checks.withColumn("passed", F.col("missing_count") == 0)


def all_passed(results: DataFrame, column: str = "passed") -> DataFrame:
    """One verdict row; an empty table passes."""
    return results.agg(F.coalesce(F.bool_and(F.coalesce(F.col(column), F.lit(False))), F.lit(True)).alias("all_passed"))


# --- realtime evaluation -----------------------------------------------------------------------


def matching_cases(
    docs: DataFrame, searchable: Column, cases: Sequence[EvaluationCase] = catalog.EVALUATION_CASES
) -> DataFrame:
    """One row per document and case whose marker its lower-cased text contains.

    The markers are a driver-side list: each row tests them in place and explodes its few hits, so
    there is no cross join. Adds ``case_ord`` and the case columns.
    """
    # The text is bound to a variable, so that it is put together once per row and not once per marker.
    hits = F.transform(
        F.array(searchable),
        lambda hay: F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(c.marker.lower())), F.lit(n)) for n, c in enumerate(cases)])),
    )
    df = docs.withColumn("case_ord", F.explode(F.flatten(hits))).drop("_hay")
    return df.join(F.broadcast(catalog.evaluation_cases_df(docs.sparkSession, cases)), "case_ord")


#: Only gaps longer than a bucket can start an episode.
BUCKET_SECONDS = 4
_CASE_KEYS = ("case_id", "technique_id", "expected_alert", "window_seconds")


def _bucket(bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000))


def number_buckets(spans: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``case_id, _bucket, episode`` from the first and last time of what each bucket of a case holds.

    ``spans``: ``case_id, window_seconds, _bucket, first, last``, any number of rows per bucket. Something later than the case's window
    after what came before it starts a new episode. The running count walks buckets, not sightings. A window shorter
    than ``bucket_seconds`` fails the run.
    """
    ends = spans.groupBy("case_id", "_bucket").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.when(F.min("window_seconds") < bucket_seconds, F.raise_error(F.lit("a case's window is shorter than bucket_seconds")))
        .otherwise(F.max("window_seconds")).alias("w"),
    )
    order = Window.partitionBy("case_id").orderBy("_bucket")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(order))
    starts = ends.withColumn("_new", F.when(gap.isNull() | (gap > F.col("w").cast("bigint") * 1_000_000), 1).otherwise(0))
    return starts.select("case_id", "_bucket", F.sum("_new").over(order).cast("bigint").alias("episode"))


def with_episodes(activity: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``episode`` (numbered from 1 per case) to marker sightings: ``case_id, window_seconds, ts``, one row each."""
    rows = activity.withColumn("_bucket", _bucket(bucket_seconds))
    spans = rows.select("case_id", "window_seconds", "_bucket", F.col("ts").alias("first"), F.col("ts").alias("last"))
    return rows.join(number_buckets(spans, bucket_seconds), ["case_id", "_bucket"]).drop("_bucket")


def activity(sightings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sightings and alerts as one table: the case columns, ``ts``, ``kind`` (event or alert), ``id``, ``rule_id`` and whether an alert fits its case."""
    common = [*_CASE_KEYS, "ts"]
    fits = F.when(F.size("expected_rule_ids") == 0, F.lit(True)).otherwise(F.array_contains("expected_rule_ids", F.col("rule_id")))
    seen = sightings.select(
        *common, F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("rule_id"), F.lit(False).alias("fits")
    )
    return seen.unionByName(alerts.select(*common, F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "rule_id", fits.alias("fits")))


def untimed(rows: DataFrame) -> DataFrame:
    """``case_id, kind, id, reason`` of activity without a readable time: it belongs to no episode and is reported instead of being dropped."""
    return rows.where(F.col("ts").isNull()).select("case_id", "kind", "id", F.lit("missing_time").alias("reason"))


def evaluate_episodes(sightings: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """``episodes_of`` sightings and alerts."""
    return episodes_of(activity(sightings, alerts), as_of)


def episodes_of(rows: DataFrame, as_of: Column) -> DataFrame:
    """Each episode of some ``activity`` with its outcome at ``as_of``.

    Sightings have case columns with ``ts, event_id``, alerts case columns with ``ts, alert_id, rule_id``; an
    alert has the time of an event that shows the same marker. A benign marker with any alert is a
    false positive, an expected one with a fitting rule a true positive. Without those, an
    episode is pending until its window has passed since it was first seen. An alert of an unexpected
    rule leaves an expected case waiting. Activity without a time is left to ``untimed``.
    """
    rows = rows.where(F.col("ts").isNotNull()).withColumn("_bucket", _bucket(BUCKET_SECONDS))
    is_event = F.col("kind") == "event"
    # Combined per bucket and rule before anything is shuffled, and small: it is read twice.
    spans = cut_lineage(
        rows.groupBy(*_CASE_KEYS, "_bucket", "rule_id").agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(is_event).alias("events"), F.count_if(~is_event).alias("alerts"),
            F.max("fits").alias("fits"),
        )
    )
    numbered = spans.join(number_buckets(spans), ["case_id", "_bucket"])
    # Distinct rule ids are kept as (few) rows until the last step.
    per_rule = numbered.groupBy(*_CASE_KEYS, "episode", "rule_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.sum("alerts").alias("alerts"),
        F.max("fits").alias("fits"),
    )
    episodes = per_rule.groupBy(*_CASE_KEYS, "episode").agg(
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
        F.sum("events").alias("event_count"),
        F.sum("alerts").alias("alert_count"),
        F.max("fits").alias("fits"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("actual_rule_ids"),
    )
    expired = F.unix_micros(as_of) - F.unix_micros("first_seen") >= F.col("window_seconds").cast("bigint") * 1_000_000
    expected = F.col("expected_alert")
    outcome = (
        F.when(expected & F.col("fits"), F.lit("true_positive"))
        .when(~expected & (F.col("alert_count") > 0), F.lit("false_positive"))
        .when(~expired, F.lit(""))
        .when(expected, F.lit("false_negative"))
        .otherwise(F.lit("true_negative"))
    )
    return episodes.withColumn("classification", outcome).withColumn(
        "status", F.when(F.col("classification") == "", F.lit("pending")).otherwise(F.lit("complete"))
    ).drop("fits")


def link_rows(rows: DataFrame) -> DataFrame:
    """``case_id, episode, kind, id``, each once: the event, alert and rule ids of activity that has its episode."""
    links = F.array(
        F.struct("kind", "id"), F.when(F.col("kind") == "alert", F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("id")))
    )
    one = rows.select("case_id", "episode", F.explode(F.array_compact(links)).alias("l")).select("case_id", "episode", "l.kind", "l.id")
    return one.where(S.text(F.col("id")) != "").distinct()


def episode_links(rows: DataFrame) -> DataFrame:
    """The ids behind each episode of some ``activity`` as rows, which grow with the input; an episode itself holds none."""
    return link_rows(with_episodes(rows.where(F.col("ts").isNotNull())))


def last_links(links: DataFrame) -> DataFrame:
    """The links of each case's last episode, whose ids a state shows."""
    last = links.groupBy("case_id").agg(F.max("episode").alias("episode"))
    return links.join(last, ["case_id", "episode"])


def latest_states(episodes: DataFrame, cases: DataFrame) -> DataFrame:
    """The current state per case: its last episode, or not seen."""
    last = episodes.groupBy("case_id").agg(
        F.max_by(F.struct("status", "classification", "first_seen", "last_seen", "event_count", "alert_count", "actual_rule_ids"), "episode").alias("s")
    )
    df = cases.join(last, "case_id", "left")
    return df.select(
        *cases.columns,
        F.coalesce(F.col("s.status"), F.lit("not_seen")).alias("status"),
        F.coalesce(F.col("s.classification"), F.lit("")).alias("classification"),
        F.col("s.first_seen").alias("first_seen"),
        F.col("s.last_seen").alias("last_seen"),
        F.coalesce(F.col("s.event_count"), F.lit(0).cast("bigint")).alias("event_count"),
        F.coalesce(F.col("s.alert_count"), F.lit(0).cast("bigint")).alias("alert_count"),
        F.coalesce(F.col("s.actual_rule_ids"), F.lit("")).alias("actual_rule_ids"),
    )


def state_counts(states: DataFrame) -> DataFrame:
    """One row: cases, observed cases, the four classes, pending and not seen."""
    done = F.col("classification").isin(*CLASSES)
    pending = ~done & (F.col("status") == "pending")
    return states.agg(
        F.count("*").alias("case_count"),
        F.count_if(done | pending).alias("observed_case_count"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES],
        F.count_if(pending).alias("pending"),
        F.count_if(~done & ~pending).alias("not_seen"),
    )


def case_table(spark: SparkSession, cases: Sequence[EvaluationCase] = catalog.EVALUATION_CASES) -> DataFrame:
    return catalog.evaluation_cases_df(spark, cases)
