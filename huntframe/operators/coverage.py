"""Coverage roll-ups: rule inventory, technique aggregates and scores, capability status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import scalars as S
from .rules import NATIVE_RULES, SIGMA_LIKE_RULES, rules_df
from .sequences import SEQUENCES


def rule_inventory(spark: SparkSession) -> DataFrame:
    """The rules of all three engines in one table."""
    columns = (
        "rule_id", "engine", "rule_name", "severity", "confidence", "technique_id", "technique_name", "tactic",
        "event_code",
    )
    native = rules_df(spark, NATIVE_RULES).select(*columns)
    sigma = rules_df(spark, SIGMA_LIKE_RULES).select(*columns)
    behavioral = spark.createDataFrame(
        [
            (d.rule_id, "behavioral", d.name, d.severity, d.confidence, d.technique_id, d.technique_name,
             list(d.tactic), d.event_codes)
            for d in SEQUENCES
        ],
        native.schema,
    )
    return native.unionByName(sigma).unionByName(behavioral)


def covered_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (t, catalog.TECHNIQUE_NAMES[t], [tactic], codes, list(engines))
            for t, tactic, codes, engines in catalog.COVERED_TECHNIQUES
        ],
        "technique_id string, technique_name string, tactic array<string>, event_code string, engines array<string>",
    )


def engine_summary(inventory: DataFrame) -> DataFrame:
    count = lambda e: F.count_if(F.col("engine") == e)
    return inventory.agg(
        count("native").alias("native_rule_count"),
        count("sigma-like").alias("sigma_like_rule_count"),
        count("behavioral").alias("behavioral_rule_count"),
        F.count_if(F.col("engine").isin("native", "sigma-like", "behavioral")).alias("total_rule_count"),
    )


def filtered_alert_counts(alerts: DataFrame, technique_id: str = "T1059.001") -> DataFrame:
    """Alerts of one technique: all, native (no engine tag) and Sigma-like."""
    engine = F.col("detection.engine")
    return alerts.where(F.col("attack.technique.id") == technique_id).agg(
        F.count("*").alias("total_count"),
        F.count_if(engine.isNull()).alias("native_count"),
        F.count_if(engine == "sigma-like").alias("sigma_like_count"),
    )


def collection_counts(spark: SparkSession, collections: dict[str, DataFrame]) -> DataFrame:
    """Row count per named collection; all are counted in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in collections.items()]
    if not parts:
        return spark.createDataFrame([], "collection string, n bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_and_engine_counts(alerts: DataFrame) -> DataFrame:
    """Alert counts per rule id and per engine (native by default) as ``kind, key, n``."""
    engine = F.coalesce(S.non_empty(F.col("detection.engine")), F.lit("native"))
    pairs = F.array(
        F.struct(F.lit("rule").alias("kind"), F.col("rule.id").alias("key")),
        F.struct(F.lit("engine").alias("kind"), engine.alias("key")),
    )
    return alerts.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count("*").alias("n"))


def response_evidence() -> Column:
    """True if a case shows a planned response or protection."""
    protection = F.coalesce(S.non_empty(F.col("expected_protection")), F.lit("none"))
    return (
        F.coalesce(F.col("expected_response"), F.lit(False))
        | (F.coalesce(F.col("response_count"), F.lit(0)) > 0)
        | (F.coalesce(F.col("indexed_response_count"), F.lit(0)) > 0)
        | (protection != "none")
    )


def score_technique(engines: Column, case_count: Column, has_response: Column) -> Column:
    """Communication score from 1 to 5 of a technique."""
    two_basic = (
        (F.size(engines) == 2) & F.array_contains(engines, "native") & F.array_contains(engines, "sigma-like")
    )
    return (
        F.when(F.size(engines) <= 1, F.lit(1))
        .when(two_basic, F.lit(2))
        .when(case_count <= 0, F.lit(3))
        .when(has_response & F.array_contains(engines, "behavioral"), F.lit(5))
        .otherwise(F.lit(4))
    )


def aggregate_techniques(
    covered: DataFrame, inventory: DataFrame, cases: DataFrame | None = None, sequence_counts: DataFrame | None = None
) -> DataFrame:
    """Per technique the union of what the covered table, the rules and the cases say about it.

    ``cases``: one row per case with ``technique_id, classification, actual_engines, actual_rule_ids, event_code``
    and the columns ``response_evidence`` reads. ``sequence_counts``: ``sequence_name, n``. Cases and
    sequences of unknown techniques are left out. Sets are built from rows that were made distinct first.
    """
    spark = covered.sparkSession
    empty = F.array().cast("array<string>")
    known = lambda c: S.text(F.col(c)) != ""

    def facts(df: DataFrame, **parts: Column) -> DataFrame:
        """Long form: one row per technique, kind of fact and value."""

        def tagged(kind: str, values: Column) -> Column:
            return F.transform(F.coalesce(values, empty), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

        pieces = [tagged(kind, values) for kind, values in parts.items()]
        return (
            df.where(known("technique_id"))
            .select(F.trim("technique_id").alias("technique_id"), F.explode(F.concat(*pieces)).alias("f"))
            .select("technique_id", "f.kind", "f.value")
        )

    base = facts(
        covered, name=F.array("technique_name"), tactic=F.col("tactic"), engine=F.col("engines"),
        code=S.split_event_codes(F.col("event_code")),
    ).unionByName(
        facts(
            inventory, name=F.array("technique_name"), tactic=F.col("tactic"), engine=F.array("engine"),
            rule=F.array("rule_id"), code=S.split_event_codes(F.col("event_code")),
        )
    )
    techniques = base.select("technique_id").distinct()
    case_totals = None
    if cases is not None:
        base = base.unionByName(
            facts(
                cases, engine=F.col("actual_engines"), rule=F.col("actual_rule_ids"),
                code=S.split_event_codes(F.col("event_code")),
            )
        )
        is_class = lambda c: F.count_if(F.col("classification") == c)
        case_totals = cases.groupBy("technique_id").agg(
            F.count("*").alias("demo_case_count"),
            is_class("true_positive").alias("true_positive_count"),
            is_class("false_positive").alias("false_positive_count"),
            is_class("false_negative").alias("false_negative_count"),
            F.bool_or(response_evidence()).alias("has_response_or_protection"),
        )
    distinct = base.where(S.text(F.col("value")) != "").distinct()
    pick = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("value")))
    sets = distinct.groupBy("technique_id").agg(
        F.max(F.when(F.col("kind") == "name", F.col("value"))).alias("technique_name"),
        S.ordered_by(pick("tactic"), catalog.TACTIC_ORDER).alias("tactic"),
        S.ordered_by(pick("engine"), catalog.ENGINE_ORDER).alias("engines"),
        F.array_sort(pick("rule")).alias("rule_ids"),
        S.ordered_event_ids(pick("code")).alias("telemetry_event_ids"),
    )
    df = techniques.join(sets, "technique_id", "left")
    if case_totals is not None:
        df = df.join(case_totals, "technique_id", "left")
    if sequence_counts is not None:
        named = spark.createDataFrame(list(catalog.SEQUENCE_TECHNIQUES.items()), "sequence_name string, technique_id string")
        per_technique = (
            sequence_counts.join(F.broadcast(named), "sequence_name")
            .groupBy("technique_id")
            .agg(F.sum("n").alias("sequence_count"))
        )
        df = df.join(per_technique, "technique_id", "left")
    zero = F.lit(0).cast("bigint")
    numbers = ("demo_case_count", "true_positive_count", "false_positive_count", "false_negative_count", "sequence_count")
    for c in numbers:
        df = df.withColumn(c, F.coalesce(F.col(c), zero) if c in df.columns else zero)
    flag = "has_response_or_protection"
    df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False))
    df = df.withColumn("technique_name", F.coalesce("technique_name", "technique_id"))
    return df.withColumn("score", score_technique(F.col("engines"), F.col("demo_case_count"), F.col(flag)))


def stored_sequences(alerts: DataFrame) -> DataFrame:
    """``sequence_name, n`` of stored alerts that name a sequence; the table's day partitions select what is read."""
    name = F.col("detection.sequence_name")
    return alerts.where(S.text(name) != "").groupBy(name.alias("sequence_name")).agg(F.count("*").alias("n"))


def technique_rank() -> Column:
    """Sort key: the required techniques in their order, all others after them."""
    known = F.array_position(S.str_array(catalog.TECHNIQUE_ORDER), F.col("technique_id"))
    return F.when(known > 0, known).otherwise(len(catalog.TECHNIQUE_ORDER) + 1)


def _engine_labels(engines: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in catalog.ENGINE_LABELS.items() for x in pair])
    return F.transform(engines, lambda e: F.coalesce(F.element_at(labels, e), e))


def navigator_rows(aggregates: DataFrame) -> DataFrame:
    """Layer rows of technique aggregates: score, colour, tactic slug, comment, notes and metadata pairs."""
    engines, technique = F.col("engines"), F.col("technique_id")
    labels = _engine_labels(engines)
    codes = F.coalesce(S.non_empty(F.array_join("telemetry_event_ids", "/")), F.lit("unknown"))
    behavioral, anomaly = F.array_contains(engines, "behavioral"), F.array_contains(engines, "ml-anomaly")
    # Comment and note texts.
    comment = (
        F.when(
            technique == "T1218",
            F.lit(
                "T1218 is constrained T1218-lite demo coverage for deterministic LOLBin execution and "
                "behavioral sequence evidence."
            ),
        )
        .when(
            (technique == "T1059.001") & anomaly,
            F.concat(
                F.lit("T1059.001 covered by native, Sigma-like, and ML anomaly demo evidence using Sysmon Event ID "),
                codes,
                F.lit(" process telemetry."),
            ),
        )
        .otherwise(
            F.concat(
                technique, F.lit(" covered by "), S.join_human(labels), F.lit(" detections using Sysmon Event ID "),
                codes, F.lit(" evidence."),
            )
        )
    )
    notes = F.array_compact(
        F.array(
            F.when(behavioral, F.lit("Includes behavioral correlation coverage.")),
            F.when(anomaly, F.lit("Includes ML anomaly demo evidence.")),
            F.when(F.col("demo_case_count") > 0, F.lit("Includes demo case evidence.")),
            F.when(F.col("has_response_or_protection"), F.lit("Includes lab-only response/protection evidence.")),
            F.when(
                F.col("sequence_count") > 0,
                F.concat(F.lit("Dashboard sequence count: "), F.col("sequence_count").cast("string"), F.lit(".")),
            ),
            F.when(technique == "T1218", F.lit("T1218-lite is constrained deterministic demo coverage.")),
        )
    )
    slugs = F.create_map(*[F.lit(x) for pair in catalog.TACTIC_SLUGS.items() for x in pair])
    colors = F.create_map(*[F.lit(x) for pair in catalog.SCORE_COLORS.items() for x in pair])
    tactic = F.get("tactic", F.lit(0))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    df = aggregates.withColumn("notes", notes)
    metadata = F.filter(
        F.array(
            pair("engines", F.array_join(labels, ", ")),
            pair("rule_ids", F.array_join("rule_ids", ", ")),
            pair("demo_case_count", F.col("demo_case_count")),
            pair("true_positive_count", F.col("true_positive_count")),
            pair("false_positive_count", F.col("false_positive_count")),
            pair("false_negative_count", F.col("false_negative_count")),
            pair("telemetry_event_ids", F.array_join("telemetry_event_ids", ", ")),
            pair("notes", F.array_join("notes", "; ")),
        ),
        lambda m: m["value"] != "",
    )
    return df.select(
        technique.alias("technique_id"),
        "score",
        F.element_at(colors, F.col("score")).alias("color"),
        F.coalesce(F.element_at(slugs, tactic), F.translate(F.lower(tactic), " ", "-")).alias("tactic"),
        comment.alias("comment"),
        "notes",
        metadata.alias("metadata"),
        technique_rank().alias("rank"),
    )


def case_matrix_totals(cases: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Case totals; a stored non-zero value is taken before the counted one."""
    is_class = lambda c: F.count_if(F.col("classification") == c)
    names = ("total_cases", "true_positive_count", "true_negative_count", "false_positive_count", "false_negative_count")
    counted = cases.agg(
        F.count("*").alias("total_cases"),
        *[is_class(n.removesuffix("_count")).alias(n) for n in names[1:]],
    )
    if stored is None:
        return counted
    # One stored row is asked for; more of them would be ambiguous, so they fail the run.
    only = lambda n: F.when(F.count("*") > 1, F.raise_error(F.lit("more than one stored row of totals"))).otherwise(F.max(n))
    kept = stored.agg(*[only(n).alias(f"_{n}") for n in names])
    joined = counted.join(F.broadcast(kept), how="left", on=F.lit(True))
    return joined.select(*[F.coalesce(F.nullif(F.col(f"_{n}"), F.lit(0)), F.col(n)).alias(n) for n in names])


def coverage_report(spark: SparkSession, checks: DataFrame, generated_at: str) -> DataFrame:
    """The whole report as one nested row: techniques, rules, their summary, the validations and one verdict.

    ``checks``: rows with ``passed``, one per validation. Only catalogue tables and validations are gathered, never alerts.
    """
    inventory = rule_inventory(spark)
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    verdict = checks.agg(F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(True)).alias("all_passed"))
    summary = engine_summary(inventory)
    report = spark.range(1).select(F.lit(generated_at).alias("generated_at"))
    parts = (
        listed(covered_techniques(spark), "covered_techniques"), listed(inventory, "rule_inventory"), listed(checks, "validation_results"),
        summary.select(F.struct(*summary.columns).alias("engine_coverage_summary")), verdict,
    )
    for part in parts:  # single aggregate rows
        report = report.join(F.broadcast(part), on=F.lit(True))
    return report


def capability_status(capabilities: DataFrame, validations: DataFrame) -> DataFrame:
    """Capability rows with the combined status of the validations they depend on.

    ``capabilities``: ``capability, validation_ids``; ``validations``: ``id, status``. A validation that did not run
    counts as failed; a capability without validations has passed.
    """
    needs = capabilities.select("capability", F.explode_outer("validation_ids").alias("id"))
    joined = needs.join(validations.select("id", "status"), "id", "left")
    ok = F.col("id").isNull() | F.coalesce(F.col("status") == "passed", F.lit(False))
    return joined.groupBy("capability").agg(
        F.when(F.bool_and(ok), F.lit("passed")).otherwise(F.lit("failed")).alias("status")
    )


def technique_cross_check(covered: DataFrame, inventory: DataFrame) -> DataFrame:
    """Covered techniques whose engines differ from the engines of their rules."""
    from_rules = inventory.groupBy("technique_id").agg(F.array_sort(F.collect_set("engine")).alias("rule_engines"))
    stated = covered.select("technique_id", F.array_sort("engines").alias("stated_engines"))
    both = stated.join(from_rules, "technique_id", "full")
    return both.where(~F.col("stated_engines").eqNullSafe(F.col("rule_engines")))


def order_preferred(df: DataFrame, column: str, preferred: Sequence[str]) -> DataFrame:
    """Rows sorted by a preferred value order, other values after it alphabetically."""
    position = F.array_position(S.str_array(preferred), F.col(column))
    return df.orderBy(F.when(position > 0, position).otherwise(len(preferred) + 1), column)
