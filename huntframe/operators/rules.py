"""Single-event rules compiled to Columns and evaluated in one projection.

Every rule becomes one ``array<string>`` Column of matched field names. All rules of an engine
sit in one array that is filtered and exploded, so detection is a scan without join or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..catalog import Condition, Rule
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS

_TEXT_OF = {
    "sysmon.event_data": lambda: S.map_text(F.col("sysmon.event_data")),
    "sysmon.event_data.Details": lambda: S.text(F.element_at(F.col("sysmon.event_data"), "Details")),
    "registry.data.strings": lambda: S.array_text(F.col("registry.data.strings")),
    "@timestamp": lambda: S.text(F.col("`@timestamp`")),
    **{path: lambda path=path: S.text(F.to_json(F.col(path))) for path in ("registry.data", "evidence", "source_event", "related_events")},
}
# Fields the programmatic rules and step matchers read, and the name each gets in ``_t``.
_PREPARED = {
    "process.name": "name",
    "process.command_line": "command_line",
    "sysmon.event_data": "event_data",
    "sysmon.event_data.Details": "details",
    "file.path": "file_path",
    "file.name": "file_name",
    "registry.path": "registry_path",
    "registry.value": "registry_value",
    "registry.data.strings": "registry_data",
    "destination.ip": "dest_ip",
    "destination.domain": "dest_domain",
    "raw.message": "raw_message",
    "process.executable": "executable",
    "@timestamp": "timestamp",
}


def field_text(path: str) -> Column:
    """Searchable text of a field: strings as they are, lists and maps as JSON, missing as empty."""
    special = _TEXT_OF.get(path)
    return special() if special else S.text(F.col(path))


def prepare(events: DataFrame) -> DataFrame:
    """Adds the ``_t_`` columns: the lower-cased texts that rules share, computed once per event.

    They are top-level columns and not one struct, because the optimizer unfolds struct fields
    into every place that reads them. ``_t_code`` is the event code as a number; where the reader
    saw it as text (``code_is_string``) it is null, because typed gates do not match text codes.
    """
    code = F.col("event.code")
    if "code_is_string" in events.columns:
        code = F.when(~F.coalesce(F.col("code_is_string"), F.lit(False)), code)
    texts = {f"_t_{name}": F.lower(field_text(path)) for path, name in _PREPARED.items()}
    return events.withColumns({**texts, "_t_code": code})


def unprepare(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


def lowered(path: str) -> Column:
    return F.col(f"_t_{_PREPARED[path]}")


def _event_text(paths: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[lowered(p) if p in _PREPARED else F.lower(field_text(p)) for p in paths])


def batch_event_text() -> Column:
    """Lower-cased searchable text of an event, as the sequence matchers see it."""
    return _event_text(
        (
            "@timestamp", "event.created", "event.code", "process.name", "process.command_line", "file.path",
            "file.name", "registry.path", "registry.value", "registry.data.strings", "destination.ip",
            "destination.domain", "sysmon.event_data",
        )
    )


def evaluation_event_text() -> Column:
    """Lower-cased text of an event in which evaluation markers are searched: every field that may show one."""
    return _event_text(
        (
            "@timestamp", "process.name", "process.executable", "process.command_line", "file.path", "registry.path",
            "registry.data", "destination.ip", "raw.message", "sysmon.event_data",
        )
    )


def evaluation_alert_text() -> Column:
    """The same of an alert document: its own fields, and its evidence, source event and related events as JSON."""
    return F.concat_ws(
        " ",
        *[F.lower(field_text(p)) for p in (
            "timestamp", "rule.id", "attack.technique.id", "process.name", "process.executable", "process.command_line", "file.path",
            "registry.path", "registry.data", "destination.ip", "evidence", "source_event", "related_events",
        )],
    )


def realtime_event_text() -> Column:
    """Lower-cased searchable text of an event, as the realtime correlator sees it."""
    return _event_text(
        (
            "@timestamp", "event.code", "process.name", "process.executable", "process.command_line",
            "file.path", "file.name", "registry.path", "registry.value", "registry.data.strings",
            "destination.ip", "destination.domain", "raw.message", "sysmon.event_data",
        )
    )


def has_category(name: str) -> Column:
    return S.category_contains(F.col("event.category"), name)


def fields(*names: str) -> Column:
    return S.str_array(names)


def _none() -> Column:
    return fields()


def download_rule() -> Column:
    """Download tool evidence, tried as process, network and file event in this order."""
    name = lowered("process.name")
    is_tool = name.isin(*catalog.DOWNLOAD_PROCESSES)
    process_hit = (
        has_category("process")
        & is_tool
        & S.lower_contains_any(lowered("process.command_line"), catalog.DOWNLOAD_MARKERS)
    )
    code = F.coalesce(F.col("_t_code"), F.lit(-1))
    marker = ("EDR_DEMO_T1105",)
    in_command = S.lower_contains_any(lowered("process.command_line"), marker)
    in_data = S.lower_contains_any(lowered("sysmon.event_data"), marker)
    no_text = (lowered("process.command_line") == "") & (lowered("sysmon.event_data") == "")
    to_ip = lowered("destination.ip") == catalog.DEMO_DESTINATION_IP
    to_domain = lowered("destination.domain") == catalog.DEMO_DESTINATION_DOMAIN
    network_hit = (code == 3) & is_tool & (to_ip | to_domain) & (no_text | in_command | in_data)
    network_fields = F.array_compact(
        F.array(
            F.when(to_ip, F.lit("destination.ip")).otherwise(F.lit("destination.domain")),
            F.when(in_command, F.lit("process.command_line")),
            F.when(in_data, F.lit("sysmon.event_data")),
        )
    )
    file_hit = (
        (code == 11)
        & S.lower_contains_any(lowered("file.path"), ("Downloads",))
        & S.lower_contains_any(lowered("file.name"), ("edr_demo",))
        & S.lower_contains_any(
            F.concat_ws(" ", lowered("file.path"), lowered("sysmon.event_data")), ("EDR_DEMO_T1105", "edr_demo")
        )
    )
    return (
        F.when(process_hit, fields("process.command_line"))
        .when(network_hit, network_fields)
        .when(file_hit, fields("file.path", "file.name"))
        .otherwise(_none())
    )


def run_key_rule() -> Column:
    """A value set below a Run or RunOnce key whose data names a payload."""
    details = F.concat_ws(" ", lowered("registry.data.strings"), lowered("sysmon.event_data.Details"))
    hit = (
        (F.coalesce(F.col("_t_code"), F.lit(-1)) == 13)
        & has_category("registry")
        & (lowered("registry.value") != "")
        & S.lower_contains_any(lowered("registry.path"), catalog.RUN_KEY_PATHS)
        & S.lower_contains_any(details, catalog.RUN_KEY_DETAILS)
    )
    return F.when(hit, fields("registry.path", "registry.value", "registry.data.strings")).otherwise(_none())


def proxy_execution_rule() -> Column:
    """A proxy-execution binary started with a suspicious argument."""
    hit = (
        has_category("process")
        & lowered("process.name").isin(*catalog.PROXY_PROCESSES)
        & S.lower_contains_any(lowered("process.command_line"), catalog.PROXY_MARKERS)
    )
    return F.when(hit, fields("process.name", "process.command_line")).otherwise(_none())


_SHELL_NAME = "powershell.exe"
_SHELL_CONDITIONS = (
    Condition("process.name", "equals", (_SHELL_NAME,)),
    Condition("process.executable", "endswith", ("\\powershell.exe",)),
    Condition("process.command_line", "contains", (_SHELL_NAME,)),
)
# Technique, its name and tactic.
_SHELL = ("T1059.001", "PowerShell", ("Execution",))
_DOWNLOAD = ("T1105", "Ingress Tool Transfer", ("Command and Control",))
_RUN_KEY = ("T1547.001", "Registry Run Keys / Startup Folder", ("Persistence",))
_PROXY = ("T1218", "System Binary Proxy Execution", ("Defense Evasion",))
# Native and Sigma-like rules
# (id stem, name, description, severity, confidence, technique, codes, conditions, matcher).
_RULE_TABLE = (
    (
        "t1059_001.powershell_process_start",
        "PowerShell Process Execution",
        "Detects Windows PowerShell process creation from normalized Sysmon Event ID 1 ECS documents.",
        "medium", "high", _SHELL, (1,), _SHELL_CONDITIONS, None,
    ),
    (
        "t1105.lolbin_download",
        "T1105 LOLBin Download Marker",
        "Detects safe LOLBin download markers across process, network, and file-create demo telemetry.",
        "medium", "medium", _DOWNLOAD, (1, 3, 11), (), download_rule,
    ),
    (
        "t1547_001.registry_run_key_persistence",
        "T1547.001 Registry Run Key Persistence Marker",
        "Detects safe registry Run/RunOnce persistence markers from normalized Sysmon Event ID 13 telemetry.",
        "high", "high", _RUN_KEY, (13,), (), run_key_rule,
    ),
    (
        "t1218.lolbin_suspicious_execution",
        "T1218 LOLBin Suspicious Execution Marker",
        "Detects safe rundll32/regsvr32/mshta proxy execution markers for deterministic T1218-lite demos.",
        "medium", "medium", _PROXY, (1,), (), proxy_execution_rule,
    ),
)


def _rules(engine: str, prefix: str) -> tuple[Rule, ...]:
    return tuple(
        Rule(
            rule_id=f"{prefix}.{stem}", engine=engine, name=name, version=1, description=description,
            severity=severity, confidence=confidence, technique_id=technique[0], technique_name=technique[1],
            tactic=technique[2], event_codes=codes, conditions=conditions, matcher=matcher,
        )
        for stem, name, description, severity, confidence, technique, codes, conditions, matcher in _RULE_TABLE
    )


NATIVE_RULES = _rules("native", "det")
SIGMA_LIKE_RULES = _rules("sigma-like", "sigma_like")


def _condition(condition: Condition) -> Column:
    path = condition.field
    source = F.lower(field_text(path) if path in _TEXT_OF else F.col(path).cast("string"))
    values = [v.lower() for v in condition.values]
    if condition.op == "equals":
        return source.isin(*values)
    if condition.op == "endswith":
        return S.any_of(F.endswith(source, F.lit(v)) for v in values)
    if condition.op == "contains":
        return S.any_of(F.contains(source, F.lit(v)) for v in values)
    raise ValueError(f"unsupported rule operator {condition.op!r}")


def _gate(rule: Rule) -> Column:
    """Dataset and typed code equality; the Sigma-like gate also treats two missing values as equal."""
    dataset, code = F.col("event.dataset"), F.col("_t_code")
    if rule.engine == "sigma-like":
        code_lit = F.lit(rule.event_codes[0]) if rule.event_codes else F.lit(None).cast("int")
        return dataset.eqNullSafe(F.lit(rule.dataset)) & code.eqNullSafe(code_lit)
    if rule.dataset is None or not rule.event_codes:
        return F.lit(False)
    return F.coalesce((dataset == rule.dataset) & code.isin(*rule.event_codes), F.lit(False))


def matched_fields(rule: Rule) -> Column:
    """Names of the matched fields in rule order; empty means no match."""
    if rule.matcher is not None:
        return rule.matcher()
    hits = F.array(*[F.when(_condition(c), F.lit(c.field)) for c in rule.conditions])
    return F.when(_gate(rule), F.array_compact(hits)).otherwise(_none())


def evaluate(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every event and rule that match: the event columns plus ``rule_id`` and ``matched_fields``.

    Rules are told apart by position, so several matches of one rule stay several rows.
    """
    if not rules:
        return events.withColumn("rule_id", F.lit("")).withColumn("matched_fields", _none()).where(F.lit(False))
    prepared = events if "_t_code" in events.columns else prepare(events)
    hits = F.array(
        *[
            F.struct(
                F.lit(n).alias("rule_ord"), F.lit(r.rule_id).alias("rule_id"),
                matched_fields(r).alias("matched_fields"),
            )
            for n, r in enumerate(rules)
        ]
    )
    hits = F.filter(hits, lambda h: F.size(h["matched_fields"]) > 0)
    matched = (
        prepared.withColumn("_hit", F.explode(hits))
        .withColumns(
            {
                "rule_ord": F.col("_hit.rule_ord"),
                "rule_id": F.col("_hit.rule_id"),
                "matched_fields": F.col("_hit.matched_fields"),
            }
        )
        .drop("_hit")
    )
    return unprepare(matched)


RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("rule_version", T.IntegerType()),
        T.StructField("rule_description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("technique_id", T.StringType()),
        T.StructField("technique_name", T.StringType()),
        T.StructField("tactic", T.ArrayType(T.StringType())),
        T.StructField("dataset", T.StringType()),
        T.StructField("event_code", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def rules_df(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rule catalogue as a table; its size is the length of the given list."""
    rows = [
        (
            r.rule_id, r.engine, r.name, r.version, r.description, r.severity, r.confidence, r.technique_id,
            r.technique_name, list(r.tactic), r.dataset, "/".join(str(c) for c in r.event_codes), r.reason,
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def candidates(events: DataFrame, limit: int = 100, tie: Column | None = None) -> DataFrame:
    """The newest shell process-start candidates by time; rows without a readable time come last.

    Equal times are ordered by ``tie``, the event id by default.
    """
    name, executable, command = F.col("process.name"), F.col("process.executable"), F.col("process.command_line")
    wanted = (
        (name == _SHELL_NAME)
        | executable.ilike("%\\\\powershell.exe")
        | command.ilike("%powershell.exe%")
    )
    return (
        events.where((F.col("event.dataset") == catalog.DATASET) & (F.col("event.code") == 1) & wanted)
        .orderBy(TS.parse_iso(F.col("`@timestamp`")).desc_nulls_last(), ids.event_document_id() if tie is None else tie)
        .limit(limit)
    )


def rule_from_dict(spec: dict, engine: str = "native") -> Rule:
    """A declarative rule from its dictionary form, native (``match.any``) or Sigma-like."""
    attack = spec["attack"]
    common = dict(
        rule_id=spec["id"], engine=engine, description=spec.get("description", ""),
        confidence=spec["confidence"], technique_id=attack["technique_id"],
        technique_name=attack["technique_name"], tactic=tuple(attack["tactic"]),
    )
    if engine == "sigma-like":
        selection = spec["detection"]["selection"]
        tests = [(key.partition("|"), value) for key, value in selection.items()]
        for (_, bar, op), _ in tests:
            if bar and op not in ("equals", "endswith", "contains"):
                raise ValueError(f"unknown operator {op!r} in rule {spec['id']}")
        code = selection.get("event.code")
        return Rule(
            **common, name=spec.get("title") or spec["name"], version=1, severity=spec["level"],
            dataset=selection.get("event.dataset"), event_codes=() if code is None else (code,),
            conditions=tuple(
                Condition(path, op, tuple(v for v in value if isinstance(v, str)))
                for (path, bar, op), value in tests
                if bar
            ),
        )
    gate = spec["data_source"]
    operators = ("equals_any", "endswith_any", "contains_any")
    found = [(c["field"], next((o for o in operators if o in c), None), c) for c in spec["match"]["any"]]
    for path, op, _ in found:
        if op is None:
            raise ValueError(f"no known operator for {path} in rule {spec['id']}")
    return Rule(
        **common, name=spec["name"], version=spec["version"], severity=spec["severity"],
        dataset=gate["event_dataset"], event_codes=(gate["event_code"],),
        conditions=tuple(
            Condition(path, op.removesuffix("_any"), tuple(c[op])) for path, op, c in found
        ),
    )


def rule_violations(catalogue: DataFrame) -> DataFrame:
    """Quality checks over a rule catalogue: one row per violated check."""
    missing = lambda name: F.when(S.text(F.col(name)) == "", F.lit(f"missing:{name}"))
    checks = F.array(
        *[missing(n) for n in ("rule_id", "rule_name", "rule_description", "technique_id", "technique_name")],
        F.when(~S.text(F.col("severity")).isin(*catalog.RULE_SEVERITIES), F.lit("bad:severity")),
        F.when(~S.text(F.col("confidence")).isin(*catalog.CONFIDENCES), F.lit("bad:confidence")),
        F.when(F.col("rule_version").isNull(), F.lit("missing:rule_version")),
        F.when(
            (F.coalesce(F.size("tactic"), F.lit(0)) <= 0) | F.exists("tactic", lambda t: S.text(t) == ""),
            F.lit("bad:tactic"),
        ),
    )
    per_rule = catalogue.select("rule_id", F.explode(F.array_compact(checks)).alias("violation"))
    repeated = (
        catalogue.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("duplicate:rule_id").alias("violation"))
    )
    return per_rule.unionByName(repeated)


def union_rules(*groups: Sequence[Rule]) -> tuple[Rule, ...]:
    return reduce(lambda a, b: a + tuple(b), groups, ())
