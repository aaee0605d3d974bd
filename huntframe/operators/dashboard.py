"""Dashboard projections and roll-ups over events, alerts, cases and evaluation states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalars as S


def or_unknown(c: Column) -> Column:
    return F.coalesce(S.non_empty(c.cast("string")), F.lit("unknown"))


def or_dash(c: Column) -> Column:
    return F.coalesce(S.non_empty(c.cast("string")), F.lit("-"))


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(or_unknown(key).alias("key")).agg(F.count("*").alias("n"))


def count_engines(rows: DataFrame) -> DataFrame:
    """Alerts per engine over case rows; each engine of a case gets the case's alert count, at least one."""
    engines = F.when(F.size("actual_engines") > 0, F.col("actual_engines")).otherwise(F.array(F.lit("unknown")))
    weight = F.coalesce(F.nullif(F.col("alert_count"), F.lit(0)), F.lit(1)).cast("bigint")
    return (
        rows.select(F.explode(engines).alias("key"), weight.alias("w")).groupBy("key").agg(F.sum("w").alias("n"))
    )


def count_event_codes(rows: DataFrame) -> DataFrame:
    """Cases per supported event code; combined labels count for each of their codes."""
    codes = [str(c) for c in catalog.SUPPORTED_CODES]
    # A label lists a code as often as it occurs in it.
    parts = F.filter(F.transform(F.split(S.text(F.col("event_code")), "/"), S.strip), lambda p: p.isin(*codes))
    counted = rows.select(F.explode(parts).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return zero_fill(counted, codes)


def zero_fill(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count rows with every wanted key present; keys outside the list stay."""
    wanted = counts.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    joined = counts.join(F.broadcast(wanted.withColumn("_w", F.lit(1))), "key", "full")
    return joined.select("key", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in catalog.SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.element_at(ranks, severity), F.lit(0))


def highest_severity(case_rules: DataFrame, inventory: DataFrame) -> DataFrame:
    """Highest rule severity per case; rules without an entry count as unknown.

    ``case_rules``: ``case_id, rule_id``.
    """
    known = inventory.select("rule_id", "severity")
    # No hint: the tables are the caller's, so their measured size decides how they join.
    joined = case_rules.join(known, "rule_id", "left")
    severity = F.coalesce("severity", F.lit("unknown"))
    return joined.groupBy("case_id").agg(F.max_by(severity, severity_rank(severity)).alias("severity"))


def case_view(rows: DataFrame, detail: DataFrame, inventory: DataFrame) -> DataFrame:
    """Dashboard rows left-joined to their case detail, row values first, with the display fallbacks."""
    shared = [c for c in detail.columns if c in rows.columns and c != "case_id"]
    d = detail.select("case_id", *[F.col(c).alias(f"_d_{c}" if c in shared else c) for c in detail.columns if c != "case_id"])
    merged = rows.join(d, "case_id", "left")
    for c in shared:
        merged = merged.withColumn(c, F.coalesce(c, f"_d_{c}")).drop(f"_d_{c}")
    rules = merged.select("case_id", F.explode("actual_rule_ids").alias("rule_id"))
    ranked = highest_severity(rules, inventory)
    if "severity" in merged.columns:
        merged = merged.withColumnRenamed("severity", "_own_severity")
    else:
        merged = merged.withColumn("_own_severity", F.lit(None).cast("string"))
    has = lambda c: F.col(c) if c in merged.columns else F.lit(None).cast("string")
    return (
        merged.join(ranked, "case_id", "left")
        .withColumn("severity", F.coalesce(S.non_empty(F.col("_own_severity")), "severity", F.lit("unknown")))
        .withColumn(
            "process",
            F.coalesce(*[S.non_empty(has(c)) for c in ("process", "process_name", "image", "name")], F.lit("-")),
        )
        .withColumn("event_code", or_dash(F.col("event_code")))
        .withColumn("technique_id", or_dash(F.col("technique_id")))
        .withColumn("classification", or_unknown(F.col("classification")))
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0).cast("bigint")))
        .withColumn("expected_malicious", F.coalesce("expected_alert", F.lit(False)))
        .drop("_own_severity")
    )


def totals(rows: DataFrame, inventory: DataFrame, covered: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    main = rows.agg(
        F.count("*").alias("total_cases"),
        F.coalesce(F.sum("alert_count"), F.lit(0)).alias("total_alerts"),
        F.coalesce(F.sum("correlated_sequence_count"), F.lit(0)).alias("correlated_sequences"),
    )
    rules = inventory.agg(F.count("*").alias("rule_count"))
    techniques = covered.agg(F.count("*").alias("technique_count"))
    # Each side is a single aggregate row.
    return main.join(F.broadcast(rules), on=F.lit(True)).join(F.broadcast(techniques), on=F.lit(True))


def distinct_counts(alerts: DataFrame) -> DataFrame:
    """Distinct rules and techniques (empty and ``-`` ignored), and alerts that name a sequence."""
    usable = lambda c: F.when(~S.text(c).isin("", "-"), c)
    pairs = alerts.select(
        usable(F.col("rule_id")).alias("rule_id"),
        usable(F.col("technique_id")).alias("technique_id"),
        F.when(S.text(F.col("sequence_name")) != "", 1).otherwise(0).alias("s"),
    )
    # Reduced to one row per rule and technique before the distinct counts.
    small = pairs.groupBy("rule_id", "technique_id").agg(F.sum("s").alias("s"))
    return small.agg(
        F.count_distinct("rule_id").alias("rule_count"),
        F.count_distinct("technique_id").alias("technique_count"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("sequence_alert_count"),
    )


def response_scope(protection_counts: DataFrame, capabilities: DataFrame, validations: DataFrame, limitations: DataFrame) -> DataFrame:
    """One row describing the response scope.

    ``protection_counts``: ``key, n``; ``capabilities``: ``capability``; ``validations``: ``id, response_count``;
    ``limitations``: ``text``.
    """
    n = lambda k: F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0))
    protection = protection_counts.agg(n("dry-run").alias("dry"), n("none").alias("no"))
    shown = lambda c: F.coalesce(F.bool_or(F.col("capability") == c), F.lit(False))
    caps = capabilities.agg(
        shown("soar_dry_run").alias("soar"), shown("lab_only_protection_action").alias("lab")
    )
    planned = validations.agg(F.max(F.when(F.col("id") == "soar_fixture_response", F.col("response_count"))).alias("planned"))
    low = F.lower("text")
    stated = F.contains(low, F.lit("does not execute production containment")) | F.contains(
        low, F.lit("requires explicit --execute-protection")
    )
    limits = limitations.agg(F.coalesce(F.bool_or(stated), F.lit(False)).alias("stated"))
    one = protection
    for other in (caps, planned, limits):
        one = one.join(F.broadcast(other), on=F.lit(True))
    return one.select(
        F.when(F.col("soar"), "dry-run").otherwise("not shown").alias("soar_mode"),
        F.when(
            F.col("planned").isNotNull(), F.concat(F.col("planned").cast("string"), F.lit(" planned record in final report"))
        ).otherwise("planned response only").alias("soar_evidence"),
        F.when(F.col("lab"), "lab-only dry-run").otherwise("not shown").alias("protection_mode"),
        F.concat(F.col("dry").cast("string"), F.lit(" dry-run cases / "), F.col("no").cast("string"), F.lit(" none")).alias("protection_evidence"),
        F.when(F.col("stated"), "not implemented").otherwise("not claimed").alias("containment_mode"),
    )


def network_summary(ip: Column, port: Column) -> Column:
    host = S.text(ip)
    return F.when(port.isNull(), host).otherwise(F.concat(host, F.lit(":"), port.cast("string")))


def evidence_summary(evidence: Column, ip: Column, port: Column) -> Column:
    """First non-empty evidence: command line, file, registry, network, message."""
    e = lambda k: S.non_empty(F.element_at(evidence, k))
    return F.coalesce(
        e("process.command_line"), e("file.path"), e("registry.path"), S.non_empty(network_summary(ip, port)),
        e("raw.message"), F.lit("-"),
    )


def alert_id(alert: Column, rule: Column, timestamp: Column) -> Column:
    return F.coalesce(S.non_empty(alert), F.concat(S.text(rule), F.lit("-"), S.text(timestamp)))


def first_case_of_alerts(alerts: DataFrame, states: DataFrame, links: DataFrame) -> DataFrame:
    """The first case (by ``case_ord``) among whose rule ids or alert ids the alert's is.

    ``alerts``: ``alert_id, rule_id`` and more; ``states``: ``case_ord, case_id`` and its outcome; ``links``: ``case_id, kind, id``. Both
    directions are equality joins on ids, reduced to the lowest case first.
    """
    numbered = links.join(F.broadcast(states.select("case_id", "case_ord")), "case_id")  # the catalogue's cases
    lowest = lambda kind: (
        numbered.where(F.col("kind") == kind).groupBy(F.col("id").alias(f"{kind}_id")).agg(F.min("case_ord").alias(f"_by_{kind}"))
    )
    matched = (
        alerts.join(lowest("rule"), "rule_id", "left")
        .join(lowest("alert"), "alert_id", "left")
        .withColumn("case_ord", F.least("_by_rule", "_by_alert"))
        .drop("_by_rule", "_by_alert")
    )
    details = states.select("case_ord", "case_id", "status", "classification", "expected_alert")
    return matched.join(details, "case_ord", "left")


def alert_table(alerts: DataFrame, states: DataFrame, links: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One display row per alert with the outcome of its evaluation case, pending without one. ``keep`` names more columns of the alerts."""
    df = first_case_of_alerts(alerts, states, links)
    return df.select(
        "alert_id",
        F.coalesce(S.non_empty(F.col("classification")), S.non_empty(F.col("status")), F.lit("pending")).alias("classification"),
        "rule_id",
        "technique_id",
        "engine",
        or_unknown(F.col("severity")).alias("severity"),
        or_dash(F.col("process_name")).alias("process"),
        or_dash(F.col("event_code")).alias("event_code"),
        F.coalesce("expected_alert", F.lit(True)).alias("expected_alert"),
        F.col("case_id"),
        "timestamp",
        *keep,
    )


def observed_states(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") != "not_seen")


def summary(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Realtime summary as ``metric, key, value`` rows: counts by code, technique, engine and severity,
    the latest times and the totals.
    """
    return summary_rows(summary_parts(events, alerts))


def summary_parts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """The summary before it is spelled out: ``metric, key, n, latest``, where ``n`` adds up and ``latest`` is a maximum.

    ``events``: ``event_code, timestamp``; ``alerts``: ``technique_id, engine, severity, timestamp``. Every row adds
    its entries once, and they are combined before they are shuffled.
    """
    entry = lambda m, k: F.struct(F.lit(m).alias("metric"), k.alias("key"))

    def entries(df: DataFrame, parts: Sequence[Column]) -> DataFrame:
        return df.select(F.explode(F.array(*parts)).alias("e"), "timestamp").select("e.metric", "e.key", "timestamp")

    ev = entries(
        events,
        [entry("event_count_by_code", or_unknown(F.col("event_code"))), entry("event", F.lit(""))],
    )
    al = entries(
        alerts,
        [
            entry("alert_count_by_technique", or_unknown(F.col("technique_id"))),
            entry("alert_count_by_engine", or_unknown(F.col("engine"))),
            entry("severity_counts", or_unknown(F.col("severity"))),
            entry("alert", F.lit("")),
        ],
    )
    return ev.unionByName(al).groupBy("metric", "key").agg(F.count("*").alias("n"), F.max("timestamp").alias("latest"))


def summary_rows(grouped: DataFrame) -> DataFrame:
    total = F.col("key") == ""
    out = F.when(
        total & F.col("metric").isin("event", "alert"),
        F.array(
            F.struct(F.concat("metric", F.lit("_count")).alias("metric"), F.lit("").alias("key"), F.col("n").cast("string").alias("value")),
            F.struct(F.concat(F.lit("latest_"), "metric", F.lit("_at")).alias("metric"), F.lit("").alias("key"), F.coalesce("latest", F.lit("")).alias("value")),
        ),
    ).otherwise(F.array(F.struct("metric", "key", F.col("n").cast("string").alias("value"))))
    return grouped.select(F.explode(out).alias("r")).select("r.*")


def count_maps(long_counts: DataFrame) -> DataFrame:
    """``metric, key, n`` rows to one sorted map text per metric."""
    pairs = F.array_sort(F.collect_list(F.struct("key", F.col("n").cast("string").alias("n"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["n"])), ",")
    return long_counts.groupBy("metric").agg(text.alias("counts"))


def latest(rows: DataFrame, limit: int, timestamp: str = "timestamp", order: str = "seq") -> DataFrame:
    """The newest rows, newest first; a top-k, not a sort of everything."""
    return rows.orderBy(F.col(timestamp).desc_nulls_last(), F.col(order).desc()).limit(limit)
