"""Alert documents as typed rows.

Absent sections are null, and ``to_json`` leaves nulls out on export. Rule metadata joins from
the rule catalogue, a driver-side list whose size is known when the plan is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ANOMALY_RULE, Rule
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS
from . import rules as R

ALERT_SECTIONS = (
    "alert", "rule", "attack", "event", "host", "user", "process", "file", "registry",
    "destination", "network", "detection", "ml", "src_doc", "art",
)
_ML_TYPE = (
    "struct<score:double,threshold:double,features:struct<process_name:string,process_executable:string,"
    "parent_process_name:string,process_command_line:string,command_line_length:int,args_count:int,"
    "executable_directory_depth:int,has_encoded_command:boolean,has_network_tool_flag:boolean,"
    "matched_network_keywords:array<string>,hour_of_day:int>,reasons:array<string>>"
)
_DETECTION_TYPE = (
    "struct<engine:string,matched_fields:array<string>,sequence_name:string,sequence_steps:array<string>,"
    "correlated_event_count:int,reason:string>"
)
_SRC_TYPE = "struct<index:string,document_id:string,document_ids:array<string>>"


def selected_event() -> Column:
    e = lambda f: F.col(f"event.{f}").alias(f)
    return F.struct(e("dataset"), e("code"), e("kind"), e("category"), e("type"), e("created"))


def selected_process() -> Column:
    p = lambda f: F.col(f"process.{f}").alias(f)
    parent = F.when(
        F.col("process.parent").isNotNull(),
        F.struct(*[F.col(f"process.parent.{f}").alias(f) for f in ("pid", "entity_id", "name", "executable", "command_line")]),
    )
    return F.when(
        F.col("process").isNotNull(),
        F.struct(p("pid"), p("entity_id"), p("name"), p("executable"), p("command_line"), parent.alias("parent")),
    )


def with_source(events: DataFrame, index: Column | None = None, document_id: Column | None = None) -> DataFrame:
    """Adds the identity of the stored document each event came from."""
    return events.withColumn(
        "src_doc",
        F.struct(
            (index if index is not None else F.lit(None).cast("string")).alias("index"),
            (document_id if document_id is not None else F.lit(None).cast("string")).alias("document_id"),
        ),
    )


_PAYLOAD = ("event", "host", "user", "process", "file", "registry", "destination", "network", "src_doc", "art")


def _id_material() -> list[Column]:
    """Fields behind a single-event alert id, apart from engine, rule and executable."""
    return [
        F.col("event.dataset"),
        F.col("event.code"),
        F.coalesce(S.non_empty(F.col("event.created")), F.col("`@timestamp`")),
        F.col("host.name"),
        F.col("process.entity_id"),
        F.col("process.pid"),
    ]


def _with_payload(events: DataFrame) -> DataFrame:
    """Adds the alert sections and id fields as flat ``_p_`` columns.

    They are made before the rules multiply rows, so that nothing above the generator reaches into the
    event structs.
    """
    sections = {"event": selected_event(), "process": selected_process()}
    columns = {f"_p_{name}": sections.get(name, F.col(name)) for name in _PAYLOAD}
    columns |= {f"_p_id{n}": c.cast("string") for n, c in enumerate(_id_material())}
    columns |= {
        "_p_executable": F.col("process.executable"),
        "_p_name": F.col("process.name"),
        "_p_command": F.col("process.command_line"),
        "_p_document": F.col("src_doc.document_id"),
    }
    return events.withColumns(columns)


def _alert_id() -> Column:
    """Id of a single-event alert; the two engines hash slightly different material."""
    sigma = F.col("engine") == "sigma-like"
    # Native alerts fall back to the process name where the path is empty.
    own = F.coalesce(S.non_empty(F.col("_p_executable")), F.col("_p_name"))
    material = [
        F.when(sigma, F.lit("sigma-like")).otherwise(F.lit("native")),
        F.col("rule_id"),
        *[F.col(f"_p_id{n}") for n in range(len(_id_material()))],
        F.when(sigma, F.col("_p_executable")).otherwise(own),
        F.col("_p_command"),
        F.col("_p_document"),
    ]
    return ids.prefixed(ids.slug(F.col("rule_id")), material)


def detect(
    events: DataFrame, rules: Sequence[Rule], created_at: str | dt.datetime | None = None
) -> DataFrame:
    """Single-event alerts of the given rules over normalized events."""
    if "src_doc" not in events.columns:
        events = with_source(events)
    hits = R.evaluate(_with_payload(events), rules)
    hits = hits.select("rule_id", "matched_fields", *[c for c in hits.columns if c.startswith("_p_")])
    catalogue = R.rules_df(events.sparkSession, rules)
    df = hits.join(F.broadcast(catalogue), "rule_id")
    sigma = F.col("engine") == "sigma-like"
    section = lambda n: F.col(f"_p_{n}").alias(n)
    return df.select(
        F.struct(
            _alert_id().alias("id"),
            F.lit("signal").alias("kind"),
            F.lit("open").alias("status"),
            TS.created_literal(created_at).alias("created"),
            F.col("severity").alias("severity"),
            F.col("confidence").alias("confidence"),
        ).alias("alert"),
        F.struct(
            F.col("rule_id").alias("id"),
            F.col("rule_name").alias("name"),
            F.col("rule_version").alias("version"),
            F.col("rule_description").alias("description"),
        ).alias("rule"),
        F.struct(
            F.struct(F.col("technique_id").alias("id"), F.col("technique_name").alias("name")).alias("technique"),
            F.col("tactic").alias("tactic"),
        ).alias("attack"),
        *[section(n) for n in ("event", "host", "user", "process", "file", "registry", "destination", "network")],
        # Native alerts carry no engine tag; readers default it.
        F.struct(
            F.when(sigma, F.lit("sigma-like")).alias("engine"),
            F.col("matched_fields"),
            F.lit(None).cast("string").alias("sequence_name"),
            F.lit(None).cast("array<string>").alias("sequence_steps"),
            F.lit(None).cast("int").alias("correlated_event_count"),
            F.lit(None).cast("string").alias("reason"),
        ).cast(_DETECTION_TYPE).alias("detection"),
        F.lit(None).cast(_ML_TYPE).alias("ml"),
        F.struct(
            F.col("_p_src_doc")["index"].alias("index"),
            F.col("_p_document").alias("document_id"),
            F.lit(None).cast("array<string>").alias("document_ids"),
        ).cast(_SRC_TYPE).alias("src_doc"),
        section("art"),
    )


def run_engines(
    events: DataFrame, engine: str = "all", created_at: str | dt.datetime | None = None
) -> DataFrame:
    """Alerts of the ``native`` or ``sigma-like`` engine, or of both (``all``) in one scan."""
    groups = {
        "native": R.NATIVE_RULES,
        "sigma-like": R.SIGMA_LIKE_RULES,
        "all": R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES),
    }
    if engine not in groups:
        raise ValueError(f"unknown engine {engine!r}")
    return detect(events, groups[engine], created_at)


def engine_of() -> Column:
    """The engine of an alert; a missing tag means native."""
    return F.coalesce(S.non_empty(F.col("detection.engine")), F.lit("native"))


def anomaly_alerts(scored: DataFrame, created_at: str | dt.datetime | None = None) -> DataFrame:
    """Alert documents for scored process events at or above their threshold."""
    if "src_doc" not in scored.columns:
        scored = with_source(scored)
    features = F.col("features")
    material = [
        F.coalesce(S.non_empty(F.col("event.created")), F.col("`@timestamp`")),
        F.col("host.name"),
        F.col("process.entity_id"),
        F.col("process.pid"),
        F.col("process.executable"),
        F.col("process.command_line"),
        F.col("src_doc.document_id"),
        F.to_json(features),
        F.col("score"),
        F.array_join("reasons", "; "),
    ]
    df = S.where_computed(scored, F.col("is_anomaly") & (F.col("score") >= F.col("threshold")))
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        F.struct(
            ids.prefixed("det-ml-anomaly-process", material).alias("id"),
            F.lit("signal").alias("kind"),
            F.lit("open").alias("status"),
            TS.created_literal(created_at).alias("created"),
            F.lit(ANOMALY_RULE["severity"]).alias("severity"),
            F.lit(ANOMALY_RULE["confidence"]).alias("confidence"),
        ).alias("alert"),
        F.struct(
            F.lit(ANOMALY_RULE["id"]).alias("id"),
            F.lit(ANOMALY_RULE["name"]).alias("name"),
            F.lit(ANOMALY_RULE["version"]).alias("version"),
            F.lit(ANOMALY_RULE["description"]).alias("description"),
        ).alias("rule"),
        none("struct<technique:struct<id:string,name:string>,tactic:array<string>>").alias("attack"),
        selected_event().alias("event"),
        "host",
        "user",
        selected_process().alias("process"),
        none(scored.schema["file"].dataType).alias("file"),
        none(scored.schema["registry"].dataType).alias("registry"),
        none(scored.schema["destination"].dataType).alias("destination"),
        none(scored.schema["network"].dataType).alias("network"),
        F.struct(
            F.lit("ml-anomaly").alias("engine"),
            none("array<string>").alias("matched_fields"),
            none("string").alias("sequence_name"),
            none("array<string>").alias("sequence_steps"),
            none("int").alias("correlated_event_count"),
            none("string").alias("reason"),
        ).cast(_DETECTION_TYPE).alias("detection"),
        F.struct(F.col("score"), F.col("threshold"), features, F.col("reasons")).cast(_ML_TYPE).alias("ml"),
        F.struct(
            F.col("src_doc.index").alias("index"),
            F.col("src_doc.document_id").alias("document_id"),
            none("array<string>").alias("document_ids"),
        ).cast(_SRC_TYPE).alias("src_doc"),
        "art",
    )
