"""Response planning and policy decisions. Both only produce records; nothing is executed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import DEFAULT_PLAYBOOKS, Playbook
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS

_ACTIONS = "array<struct<id:string,type:string,status:string,description:string>>"


def _path(df: DataFrame, path: str) -> Column:
    """A nested field as text, or null where the input has no such column."""
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    dtype = df.schema[head].dataType
    column = F.col(f"`{head}`")
    for part in rest:
        kind = dtype.typeName()
        if kind == "map":
            return F.element_at(column, part)
        if kind != "struct" or part not in dtype.fieldNames():
            return F.lit(None).cast("string")
        dtype, column = dtype[part].dataType, column[part]
    return column


def with_alert_ids(alerts: DataFrame) -> DataFrame:
    """Adds ``alert_id``, ``rule_id``, ``technique_id`` and ``severity`` by their fallback paths."""
    at = lambda p: _path(alerts, p)
    return alerts.select(
        "*",
        F.coalesce(at("alert.id"), at("id")).alias("alert_id"),
        F.coalesce(at("alert.rule.id"), at("rule.id"), at("alert.rule_id")).alias("rule_id"),
        F.coalesce(
            at("attack.technique.id"), at("attack.technique_id"), at("art.technique_id"), at("alert.technique_id")
        ).alias("technique_id"),
        at("alert.severity").alias("alert_severity"),
    )


def alert_error() -> Column:
    """Why an alert cannot be planned for; null if it can (needs ``with_alert_ids``)."""
    no_source = (S.text(F.col("rule_id")) == "") & (S.text(F.col("technique_id")) == "")
    return F.coalesce(
        F.when(S.text(F.col("alert_id")) == "", F.lit("missing_alert_id")),
        F.when(no_source, F.lit("missing_rule_or_technique")),
    )


def playbook_violations(playbooks: DataFrame) -> DataFrame:
    """Quality checks over playbooks: one row per violated check."""
    blank = lambda n: F.when(S.text(F.col(n)) == "", F.lit(f"missing:{n}"))
    empty = lambda n: F.coalesce(F.size(n), F.lit(0)) <= 0
    checks = F.array(
        blank("id"), blank("name"), blank("description"),
        F.when(F.col("status") != "dry-run", F.lit("bad:status")),
        F.when(empty("rule_ids") & empty("technique_ids"), F.lit("missing:match")),
        F.when(empty("actions"), F.lit("missing:actions")),
        F.when(F.exists("actions", lambda a: ~a["status"].eqNullSafe("planned")), F.lit("bad:action_status")),
        F.when(
            F.exists("actions", lambda a: (S.text(a["id"]) == "") | (S.text(a["type"]) == "") | (S.text(a["description"]) == "")),
            F.lit("bad:action"),
        ),
    )
    return playbooks.select("id", F.explode(F.array_compact(checks)).alias("violation"))


def playbooks_df(spark: SparkSession, playbooks: Sequence[Playbook] = DEFAULT_PLAYBOOKS) -> DataFrame:
    rows = [
        (
            n, p.id, p.name, p.status, p.description, list(p.rule_ids), list(p.technique_ids),
            [(a.id, a.type, a.status, a.description) for a in p.actions],
        )
        for n, p in enumerate(playbooks)
    ]
    return spark.createDataFrame(
        rows,
        "ord int, id string, name string, status string, description string, rule_ids array<string>, "
        f"technique_ids array<string>, actions {_ACTIONS}",
    )


def is_planned(rule_id: Column, technique_id: Column, playbooks: Sequence[Playbook] = DEFAULT_PLAYBOOKS) -> Column:
    """Whether ``plan_responses`` would plan for an alert of this rule and technique; no join, as playbooks are a driver-side list."""

    def first(key: Column, attribute: str) -> Column:
        at: dict[str, int] = {}
        for n, p in enumerate(playbooks):
            for value in getattr(p, attribute):
                at.setdefault(value, n)
        return F.element_at(F.create_map(*[F.lit(x) for pair in at.items() for x in pair]), key) if at else F.lit(None).cast("int")

    usable = [n for n, p in enumerate(playbooks) if p.actions and all(a.status == "planned" for a in p.actions)]
    return F.coalesce(F.least(first(rule_id, "rule_ids"), first(technique_id, "technique_ids")).isin(*usable), F.lit(False))


def plan_responses(
    alerts: DataFrame,
    playbooks: Sequence[Playbook] = DEFAULT_PLAYBOOKS,
    created_at: str | dt.datetime | None = None,
) -> DataFrame:
    """One response record per valid alert that a playbook matches, by the first such playbook.

    Playbooks are a driver-side list, so their lookups are broadcast. Each alert is looked up by
    rule id and by technique id and takes the lower playbook position.
    """
    books = playbooks_df(alerts.sparkSession, playbooks)
    lookup = lambda ids_col, key: books.select(F.explode(ids_col).alias(key), "ord").groupBy(key).agg(F.min("ord"))
    by_rule = lookup("rule_ids", "rule_id").withColumnRenamed("min(ord)", "_rule_ord")
    by_technique = lookup("technique_ids", "technique_id").withColumnRenamed("min(ord)", "_technique_ord")
    details = books.select(
        "ord", F.col("id").alias("playbook_id"), F.col("name").alias("playbook_name"), "actions"
    ).where(~F.exists("actions", lambda a: a["status"] != "planned") & (F.size("actions") > 0))
    valid = with_alert_ids(alerts).where(alert_error().isNull())
    valid = valid.select("alert_id", "rule_id", "technique_id", "alert_severity")
    df = (
        valid.join(F.broadcast(by_rule), "rule_id", "left")
        .join(F.broadcast(by_technique), "technique_id", "left")
        .withColumn("ord", F.least("_rule_ord", "_technique_ord"))
        .join(F.broadcast(details), "ord")
    )
    action_ids = F.array_join(F.transform("actions", lambda a: a["id"]), "|")
    return df.select(
        F.struct(
            ids.prefixed("soar-response", [F.col("playbook_id"), F.col("alert_id"), action_ids]).alias("id"),
            F.lit("planned").alias("status"),
            F.lit("dry-run").alias("mode"),
            TS.created_literal(created_at).alias("created"),
            F.col("alert_severity").alias("severity"),
        ).alias("response"),
        F.struct(F.col("alert_id").alias("id"), "rule_id", "technique_id").alias("alert"),
        F.struct(F.col("playbook_id").alias("id"), F.col("playbook_name").alias("name")).alias("playbook"),
        "actions",
    )


def decide(
    alerts: DataFrame,
    execute: bool | Column = False,
    lab_allow_execute: bool | Column = False,
    force_lab_demo: bool | Column = False,
    explicit_pid: int | None = None,
) -> DataFrame:
    """Adds the ``decision`` struct of the process policy to alert or response rows. Flags may be columns of the alerts.

    Rows whose pid is not positive get ``decision_error`` and no decision.
    """
    df = with_alert_ids(alerts)
    at = lambda p: _path(alerts, p)
    # The alert's own process is taken as a whole where it is there, else the nested one; their fields never mix.
    own = at("process").isNotNull()
    process = lambda field: F.when(own, at(f"process.{field}").cast("string")).otherwise(at(f"alert.process.{field}").cast("string"))
    pid = F.lit(explicit_pid).cast("bigint") if explicit_pid is not None else process("pid").try_cast("bigint")
    name = S.non_empty(process("name"))
    # The policy reads the plain rule id before the one nested in the alert.
    rule_id = F.coalesce(at("rule.id"), at("alert.rule_id"), at("alert.rule.id"))
    command = S.text(process("command_line"))
    tags = F.array_join(F.col("tags"), " ") if "tags" in alerts.columns else F.lit("")
    art = F.array_join(F.map_values(F.col("art")), " ") if "art" in alerts.columns else F.lit("")
    haystack = F.concat_ws(" ", command, S.text(tags), S.text(art))
    df = df.withColumns(
        {
            "_pid": pid,
            "_name": name,
            "_rule": rule_id,
            "_haystack": F.lower(haystack),
        }
    )
    protected = F.coalesce(F.lower("_name").isin(*catalog.PROTECTED_PROCESSES), F.lit(False))
    approved = F.coalesce(F.col("_rule").isin(*catalog.APPROVED_RULE_IDS), F.lit(False))
    marked = S.lower_contains_any(F.col("_haystack"), catalog.POLICY_MARKERS)
    df = df.withColumns({"_protected": protected, "_approved": approved, "_marked": marked})
    protected, approved, marked = F.col("_protected"), F.col("_approved"), F.col("_marked")
    forced, no_pid = F.lit(force_lab_demo), F.col("_pid").isNull()
    supported = approved | marked | forced
    run, lab = F.lit(execute), F.lit(lab_allow_execute)
    goes_on = ~protected & supported
    # Check names and reason texts.
    checks = F.array_compact(
        F.array(
            F.when(~run, F.lit("dry_run_default")),
            F.when(forced, F.lit("force_lab_demo")),
            F.when(no_pid, F.lit("pid_missing")).otherwise(F.lit("pid_present")),
            F.when(protected, F.lit("protected_process_blocked")).otherwise(F.lit("process_not_protected")),
            F.when(protected, F.lit(None))
            .when(approved, F.lit("approved_rule_id"))
            .when(marked, F.lit("safe_demo_marker"))
            .when(forced, F.lit("unsupported_rule_forced_lab_demo"))
            .otherwise(F.lit("unsupported_rule_blocked")),
            F.when(goes_on & run, F.lit("execute_requested")),
            F.when(goes_on & run & ~lab, F.lit("lab_allow_execute_missing")).when(goes_on & run, F.lit("lab_allow_execute")),
        )
    )
    allowed = F.when(~goes_on, F.lit(False)).when(~run, F.lit(True)).otherwise(lab & ~no_pid)
    reason = (
        F.when(protected, F.concat(F.lit("protected process cannot be killed: "), F.col("_name")))
        .when(~supported, F.lit("rule id is not approved and no safe demo marker is present"))
        .when(
            ~run & no_pid,
            F.lit("dry-run planned for approved detection alert; PID missing so execution would be blocked"),
        )
        .when(~run, F.lit("dry-run planned for approved detection alert"))
        .when(~lab, F.lit("execute blocked because lab_allow_execute is required"))
        .when(no_pid, F.lit("execute blocked because PID is missing"))
        .otherwise(F.lit("execute allowed for approved lab protection action"))
    )
    bad_pid = F.coalesce(F.col("_pid") <= 0, F.lit(False))
    decision = F.struct(
        allowed.alias("allowed"),
        F.when(run, F.lit("execute")).otherwise(F.lit("dry-run")).alias("mode"),
        reason.alias("reason"),
        F.col("_pid").alias("pid"),
        F.col("_name").alias("process_name"),
        F.col("_rule").alias("rule_id"),
        checks.alias("safety_checks"),
    )
    return (
        df.withColumn("decision_error", F.when(bad_pid, F.lit("bad_pid")))
        .withColumn("decision", F.when(~bad_pid, decision))
        .drop("_pid", "_name", "_rule", "_haystack", "_protected", "_approved", "_marked")
    )


def protection_records(decided: DataFrame, created_at: str | dt.datetime | None = None) -> DataFrame:
    """Protection records of decided rows.

    An ``action_result`` struct column (``action``, ``status``, ``error``) is used if there is one; without
    it every allowed row is planned. A blocked decision outranks the action's status.
    """
    at = lambda p: _path(decided, p)
    action = F.coalesce(at("action_result.action"), F.lit("kill_process"))
    status = (
        F.when(~F.col("decision.allowed"), F.lit("blocked"))
        .when(at("action_result.status").isin("planned", "executed", "failed"), at("action_result.status"))
        .when(S.text(at("action_result.error")) != "", F.lit("failed"))
        .otherwise(F.lit("planned"))
    )
    d = lambda n: F.col(f"decision.{n}")
    # A planned dry run without a pid stays planned with a null pid.
    material = [F.col("alert_id"), action, d("pid"), d("mode"), d("reason")]
    return S.where_computed(decided, F.col("decision").isNotNull()).select(
        F.struct(
            ids.prefixed("protection-kill-process", material).alias("id"), action.alias("action"),
            d("mode").alias("mode"), status.alias("status"), TS.created_literal(created_at).alias("created"),
            d("reason").alias("reason"),
        ).alias("protection"),
        F.struct(d("pid").alias("pid"), d("process_name").alias("process_name"), at("host.name").alias("host")).alias("target"),
        F.struct(
            F.col("alert_id").alias("id"), F.coalesce(d("rule_id"), F.col("rule_id")).alias("rule_id"),
            F.col("technique_id").alias("technique_id"),
        ).alias("alert"),
        F.struct(d("safety_checks").alias("checks")).alias("safety"),
        F.struct(
            action.alias("action"), at("action_result.status").alias("status"), at("action_result.error").alias("error")
        ).alias("result"),
    )
