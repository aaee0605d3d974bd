"""Near-realtime rules and the process, network, file correlator in batch form.

The functions here take any DataFrame of normalized events. The stateless ones serve streams
as they are; ``streaming`` holds the stateful forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..catalog import Rule
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS
from ..session import cut_lineage
from . import alerts as A
from . import following
from . import rules as R

_MICROS = 1_000_000
STEPS = ("process", "network", "file")
SEQUENCE_NAME = "t1105_process_network_file"


def _command_or_message() -> Column:
    return F.lower(F.coalesce(S.non_empty(F.col("process.command_line")), S.text(F.col("message"))))


def _label_matcher(markers: Sequence[str]):
    def build() -> Column:
        hit = S.lower_contains_any(F.col("_t_command_or_message"), markers)
        return F.when(hit, R.fields("process.command_line")).otherwise(R.fields())

    return build


def _is_code(n: int) -> Column:
    return F.coalesce(F.col("event.code") == n, F.lit(False))


def _shell() -> Column:
    command = R.lowered("process.command_line")
    flags = (
        F.contains(command, F.lit("-noprofile"))
        | F.contains(command, F.lit(" -nop"))
        | (F.contains(command, F.lit("-executionpolicy")) & F.contains(command, F.lit("bypass")))
    )
    hit = (
        _is_code(1)
        & R.lowered("process.name").isin(*catalog.REALTIME_SHELLS)
        & (F.contains(command, F.lit("edr_demo_t1059_001")) | flags)
    )
    named = F.array_compact(
        F.array(F.lit("process.name"), F.when(command != "", F.lit("process.command_line")))
    )
    return F.when(hit, named).otherwise(R.fields())


def _download() -> Column:
    hits = F.array_compact(
        F.array(
            *[
                F.when(S.lower_contains_any(R.lowered(path), markers), F.lit(path))
                for path, markers in catalog.REALTIME_DOWNLOAD_CHECKS
            ]
        )
    )
    return F.when(R.lowered("process.name").isin(*catalog.REALTIME_DOWNLOAD_TOOLS), hits).otherwise(R.fields())


def _run_key() -> Column:
    path = R.lowered("registry.path")
    below = S.any_of(
        F.contains(path, F.lit(f"currentversion\\{key}\\")) | F.endswith(path, F.lit(f"currentversion\\{key}"))
        for key in ("run", "runonce")
    )
    return F.when(_is_code(13) & below, R.fields("registry.path", "registry.value")).otherwise(R.fields())


def _url_handler() -> Column:
    hit = (
        _is_code(1)
        & (R.lowered("process.name") == "rundll32.exe")
        & S.lower_contains_any(
            R.lowered("process.command_line"), ("edr_demo_t1218", "url.dll,fileprotocolhandler")
        )
    )
    return F.when(hit, R.fields("process.name", "process.command_line")).otherwise(R.fields())


# Realtime rules by key (id, name, technique, severity, confidence, reason, matcher).
_REALTIME_TABLE = {
    "t1059": (
        "det.realtime.t1059_001.powershell_execution", "T1059.001 PowerShell execution",
        ("T1059.001", "PowerShell", ("Execution",)), "medium", "high",
        "PowerShell process creation contains a safe demo marker or suspicious execution flags.", _shell,
    ),
    "t1105": (
        "det.realtime.t1105.ingress_tool_transfer", "T1105 Ingress Tool Transfer",
        ("T1105", "Ingress Tool Transfer", ("Command and Control",)), "medium", "medium",
        "Download-capable Windows tool used localhost/demo marker evidence.", _download,
    ),
    "t1547": (
        "det.realtime.t1547_001.registry_run_key", "T1547.001 Registry Run Key",
        ("T1547.001", "Registry Run Keys / Startup Folder", ("Persistence",)), "high", "high",
        "Sysmon Event ID 13 wrote a value below CurrentVersion\\Run or CurrentVersion\\RunOnce.", _run_key,
    ),
    "t1218": (
        "det.realtime.t1218_lite.rundll32_url_handler", "T1218-lite rundll32 URL handler",
        ("T1218", "System Binary Proxy Execution", ("Defense Evasion",)), "medium", "medium",
        "rundll32.exe command line contains a safe T1218 marker or url.dll,FileProtocolHandler.", _url_handler,
    ),
}
BEHAVIORAL_RULE = Rule(
    rule_id="behavioral.realtime.t1105.process_network_file",
    engine="behavioral",
    name="T1105 process + network + file correlation",
    version=1,
    description="",
    severity="high",
    confidence="high",
    technique_id="T1105",
    technique_name="Ingress Tool Transfer",
    tactic=("Command and Control",),
    reason="Within five minutes, one process/image or marker produced process, network, and file evidence.",
)


def _rule(key: str, reason: str | None = None, matcher=None) -> Rule:
    rule_id, name, technique, severity, confidence, own_reason, own_matcher = _REALTIME_TABLE[key]
    return Rule(
        rule_id=rule_id, engine="realtime-native", name=name, version=1, description="", severity=severity,
        confidence=confidence, technique_id=technique[0], technique_name=technique[1], tactic=technique[2],
        reason=reason or own_reason, matcher=matcher or own_matcher,
    )


# Label markers first, then the rules proper, as the alerts of one event are ordered.
REALTIME_RULES = tuple(
    _rule(key, catalog.LABEL_MARKER_REASON, _label_matcher(markers)) for key, markers in catalog.LABEL_MARKER_RULES
) + tuple(_rule(key) for key in _REALTIME_TABLE)


def evidence() -> Column:
    """Non-empty evidence values by dotted name."""
    e = lambda key, c: F.struct(F.lit(key).alias("key"), S.non_empty(c.cast("string")).alias("value"))
    entries = F.array(
        e("process.name", F.col("process.name")),
        e("process.command_line", F.col("process.command_line")),
        e("process.executable", F.col("process.executable")),
        e("parent.process.name", F.col("process.parent.name")),
        e("destination.ip", F.col("destination.ip")),
        e("destination.port", F.col("destination.port")),
        e("file.path", F.col("file.path")),
        e("registry.path", F.col("registry.path")),
        e("registry.value", F.col("registry.value")),
        e("registry.data", F.to_json(F.col("registry.data"))),
        e("raw.message", F.col("raw.message")),
    )
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


def selected_event() -> Column:
    e = lambda f: F.col(f"event.{f}").alias(f)
    return F.struct(
        e("id"), e("dataset"), F.col("event.code").cast("string").alias("code"), e("kind"), e("category"),
        e("type"), e("provider"), e("created"),
    )


def timestamp(as_of: str | None = None) -> Column:
    default = F.lit(as_of) if as_of else None
    return TS.event_timestamp(F.col("`@timestamp`"), F.col("event.created"), default)


def compact_event(as_of: str | None = None) -> Column:
    stamp = timestamp(as_of)
    return F.struct(
        ids.event_identity(stamp).alias("id"),
        stamp.alias("timestamp"),
        selected_event().alias("event"),
        F.col("host"),
        A.selected_process().alias("process"),
        F.col("file"),
        F.col("registry"),
        F.col("destination"),
        F.col("network"),
        evidence().alias("evidence"),
    )


def realtime_matches(events: DataFrame) -> DataFrame:
    """Events with each realtime rule they match, label markers included."""
    prepared = R.prepare(events).withColumn("_t_command_or_message", _command_or_message())
    return R.evaluate(prepared, REALTIME_RULES)


def realtime_alerts(events: DataFrame, as_of: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Realtime alert documents; one row per event and match, also where ids repeat. ``keep`` names columns of the events to keep."""
    spark = events.sparkSession
    hits = realtime_matches(events)
    meta = spark.createDataFrame(
        [
            (n, r.name, r.engine, r.severity, r.confidence, r.technique_id, r.technique_name, list(r.tactic), r.reason)
            for n, r in enumerate(REALTIME_RULES)
        ],
        "rule_ord int, rule_name string, engine string, severity string, confidence string, "
        "technique_id string, technique_name string, tactic array<string>, reason string",
    )
    df = hits.join(F.broadcast(meta), "rule_ord").withColumn("_stamp", timestamp(as_of))
    df = df.withColumn("_identity", ids.event_identity(F.col("_stamp")))
    material = [F.col("rule_id"), F.col("_identity"), F.col("_stamp"), *ids.section_material(), F.lit("")]
    return df.select(
        F.col("_stamp").alias("timestamp"),
        F.struct(
            ids.prefixed(ids.slug(F.col("rule_id")), material).alias("id"), F.lit("signal").alias("kind"),
            F.lit("open").alias("status"), F.col("_stamp").alias("created"), F.col("severity"), F.col("confidence"),
        ).alias("alert"),
        F.struct(
            F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.lit(1).alias("version"),
            F.col("reason").alias("description"),
        ).alias("rule"),
        F.struct(F.col("engine"), F.col("matched_fields"), F.col("reason"), F.col("reason").alias("explanation")).alias("detection"),
        "severity",
        "confidence",
        F.struct(
            F.struct(F.col("technique_id").alias("id"), F.col("technique_name").alias("name")).alias("technique"),
            F.col("tactic"),
        ).alias("attack"),
        selected_event().alias("event"),
        "host", "user",
        A.selected_process().alias("process"),
        "file", "registry", "destination", "network", "raw", "sysmon",
        evidence().alias("evidence"),
        compact_event(as_of).alias("source_event"),
        F.array().cast(T.ArrayType(_compact_type(df, as_of))).alias("related_events"),
        F.array().cast("array<string>").alias("source_event_ids"),
        F.col("_identity").alias("source_id"),
        "rule_ord",
        *keep,
    )


def _compact_type(events: DataFrame, as_of: str | None = None) -> T.DataType:
    return events.select(compact_event(as_of).alias("c")).schema["c"].dataType


def distinct_alerts(alerts: DataFrame) -> DataFrame:
    """One row per alert id: the first by source event time, then by rule order."""
    order = F.struct("timestamp", "source_id", "rule_ord")
    first = alerts.groupBy(F.col("alert.id").alias("_id")).agg(F.min_by(F.struct("*"), order).alias("_row"))
    return first.select("_row.*")


def step_name() -> Column:
    """Which correlator step an event is: process, network, file or none (needs ``R.prepare``)."""
    tool = R.lowered("process.name").isin(*catalog.REALTIME_DOWNLOAD_TOOLS)
    return (
        F.when(
            _is_code(1) & tool & S.lower_contains_any(F.col("_t_event_text"), catalog.REALTIME_PROCESS_STEP_MARKERS),
            F.lit("process"),
        )
        .when(_is_code(3) & tool, F.lit("network"))
        .when(
            _is_code(11) & S.lower_contains_any(F.col("_t_event_text"), catalog.REALTIME_FILE_STEP_MARKERS),
            F.lit("file"),
        )
    )


def correlation_keys() -> Column:
    """Entity, image (or process name) and marker keys of an event (needs ``R.prepare``)."""
    entity = F.lower(S.text(F.col("process.entity_id")))
    image, name = R.lowered("process.executable"), R.lowered("process.name")
    base = F.array(
        F.when(entity != "", F.concat(F.lit("entity:"), entity)),
        F.when(image != "", F.concat(F.lit("image:"), image)).when(name != "", F.concat(F.lit("process:"), name)),
    )
    markers = S.present_markers(F.col("_t_event_text"), catalog.REALTIME_CONTEXT_MARKERS)
    return F.array_compact(F.concat(base, F.transform(markers, lambda m: F.concat(F.lit("marker:"), m))))


def _correlation_rows(events: DataFrame, order: str) -> DataFrame:
    prepared = R.prepare(events).withColumn("_t_event_text", R.realtime_event_text())
    stamp = timestamp()
    return prepared.select(
        ids.event_identity(stamp).alias("eid"),
        stamp.alias("stamp"),
        TS.event_time(F.col("`@timestamp`"), F.col("event.created")).alias("ts"),
        F.col(order).cast("bigint").alias("o"),
        step_name().alias("step"),
        correlation_keys().alias("keys"),
        S.text(F.col("host.name")).alias("host_name"),
    )


def correlation_input(events: DataFrame, order: str = "seq", host_scoped: bool = False) -> DataFrame:
    """The slim rows the correlator reads: id, time, arrival, step and one row per key.

    Events without a readable time have no window; ``correlation_rejects`` reports them. ``host_scoped`` adds the host to every key.
    """
    scope = F.concat("host_name", F.lit("|")) if host_scoped else F.lit("")
    # Step and key leave through one generator, so that later filters on them are not pushed into the
    # text search above.
    placed = F.transform(
        F.when(F.col("ts").isNotNull(), F.col("keys")),
        lambda k: F.struct(F.concat(scope, k).alias("key"), F.col("step").alias("step"), F.col("ts").alias("ts")),
    )
    return _correlation_rows(events, order).select("eid", "stamp", "o", F.explode(placed).alias("_k")).select("eid", "stamp", "o", "_k.*")


def correlation_rejects(events: DataFrame, order: str = "seq") -> DataFrame:
    """``eid, o, step, reason``: events with a correlation key but without a readable time."""
    rows = _correlation_rows(events, order)
    return rows.where(F.col("ts").isNull() & (F.size("keys") > 0)).select("eid", "o", "step", F.lit("missing_time").alias("reason"))


def behavioral_alerts(trios: DataFrame) -> DataFrame:
    """Flat alert rows for (process, network, file) event triples; their time ``t`` stays."""
    r = BEHAVIORAL_RULE
    material = [F.lit(r.rule_id), F.col("process_id"), F.col("network_id"), F.col("file_id"), F.col("timestamp")]
    return trios.select(
        ids.prefixed(r.rule_id.translate(str.maketrans("._", "--")), material).alias("alert_id"),
        "timestamp",
        F.lit(r.rule_id).alias("rule_id"),
        F.lit(r.technique_id).alias("technique_id"),
        F.lit(r.engine).alias("engine"),
        F.lit(r.severity).alias("severity"),
        F.lit(SEQUENCE_NAME).alias("sequence_name"),
        F.lit(len(STEPS)).alias("correlated_event_count"),
        "process_id", "network_id", "file_id", "t",
    )


def correlated_alert_documents(alerts: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """Full documents of the correlator's alerts: evidence, source event and the three related events.

    ``alerts``: rows of ``behavioral_alerts``. Only ids pass through the correlator; here they are joined once with the events they name. Of events
    that share an id the first by ``order`` counts. An event that is not at hand leaves its place empty.
    """
    r = BEHAVIORAL_RULE
    stamp = timestamp()
    shown = events.select(
        ids.event_identity(stamp).alias("_event"), F.col(order).alias("_o"), compact_event().alias("_compact"),
        F.struct(
            selected_event().alias("event"), "host", "user", A.selected_process().alias("process"), "file", "registry", "destination", "network",
            evidence().alias("evidence"),
        ).alias("_doc"),
    )
    places = alerts.select("alert_id", F.posexplode(F.array("process_id", "network_id", "file_id")).alias("_step", "_event"))
    one = places.join(shown, "_event").groupBy("alert_id", "_step").agg(F.min_by(F.struct("_compact", "_doc"), "_o").alias("_found"))
    related = one.groupBy("alert_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_step", F.col("_found._compact")))).alias("_related"),
        F.max_by("_found", "_step").alias("_last"),
    )
    df = alerts.join(related, "alert_id", "left")
    return df.select(
        "timestamp",
        F.struct(
            F.col("alert_id").alias("id"), F.lit("signal").alias("kind"), F.lit("open").alias("status"), F.col("timestamp").alias("created"),
            F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
        ).alias("alert"),
        F.struct(F.lit(r.rule_id).alias("id"), F.lit(r.name).alias("name"), F.lit(1).alias("version"), F.lit(r.reason).alias("description")).alias("rule"),
        F.struct(
            F.lit(r.engine).alias("engine"), S.str_array([f"sequence.{s}" for s in STEPS]).alias("matched_fields"), F.lit(r.reason).alias("reason"),
            F.lit(r.reason).alias("explanation"), F.lit(SEQUENCE_NAME).alias("sequence_name"), S.str_array(STEPS).alias("sequence_steps"),
            F.lit(len(STEPS)).alias("correlated_event_count"),
        ).alias("detection"),
        F.lit(r.severity).alias("severity"),
        F.lit(r.confidence).alias("confidence"),
        F.struct(
            F.struct(F.lit(r.technique_id).alias("id"), F.lit(r.technique_name).alias("name")).alias("technique"), S.str_array(r.tactic).alias("tactic")
        ).alias("attack"),
        *[F.col(f"_last._doc.{c}").alias(c) for c in ("event", "host", "user", "process", "file", "registry", "destination", "network", "evidence")],
        F.col("_last._compact").alias("source_event"),
        F.array_compact(F.array(*[F.element_at("_related", F.lit(n)) for n in range(len(STEPS))])).alias("related_events"),
        F.array("process_id", "network_id", "file_id").alias("source_event_ids"),
    )


def correlated_trios(rows: DataFrame, steps: DataFrame, window_seconds: int) -> DataFrame:
    """``process_id, network_id, file_id, timestamp, t``: what the arrivals ``rows`` complete among the step events ``steps``.

    The earliest in-window event of a step is the next one after the window's start, so it is an as-of lookup and no pair is
    formed. Keys that lack a step in a window's reach are dropped before the arrivals are shuffled. ``t`` is the time of the trio's last event.
    """
    width = window_seconds * _MICROS
    own = F.floor(F.col("t") / width)
    cands = steps.select("key", "t", "o", F.col("step").alias("label"), F.struct("eid", "t", "o", "stamp").alias("cand"))
    bit = F.coalesce(*[F.when(F.col("label") == s, F.lit(1 << n)) for n, s in enumerate(STEPS)])
    # Written first, so that its real size can make the filter below a broadcast and spare the shuffle of
    # all events.
    places = cands.select("key", F.explode(F.array(own, own - 1)).alias("_bucket"), "label")
    complete = cut_lineage(
        places.groupBy("key", "_bucket").agg(F.bit_or(bit).alias("_steps")).where(F.col("_steps") == 7).select("key", "_bucket")
    )
    probes = rows.select(
        "key", (F.col("t") - width).alias("t"), F.lit(-(1 << 62)).alias("o"),
        F.floor((F.col("t") - width) / width).alias("_bucket"), F.struct("t", "o").alias("probe"),
    ).join(complete, ["key", "_bucket"], "left_semi")
    found = following.next_by_label(probes.drop("_bucket"), cands, ["key"], STEPS, width)
    arrived = S.all_of(F.struct(f"{s}.t", f"{s}.o") <= F.col("probe") for s in STEPS)
    return (
        found.where(S.all_of(F.col(s).isNotNull() for s in STEPS))
        .where(arrived)
        .select(
            *[F.col(f"{s}.eid").alias(f"{s}_id") for s in STEPS], F.col("file.stamp").alias("timestamp"),
            F.greatest(*[F.col(f"{s}.t") for s in STEPS]).alias("t"),
        )
        .distinct()
    )


def correlate(
    events: DataFrame,
    window_seconds: int = catalog.REALTIME_WINDOW_SECONDS,
    order: str = "seq",
    host_scoped: bool = False,
) -> DataFrame:
    """Correlated triples: at every event and key of it, the earliest event of each step in the window.

    Equal to feeding the correlator in time order. No task holds a key's window, however many events share it.
    """
    rows = correlation_input(events, order, host_scoped).withColumn("t", F.unix_micros("ts"))
    # Few events are steps; they are read three times, so they are materialised.
    steps = cut_lineage(rows.where("step IS NOT NULL"))
    return behavioral_alerts(correlated_trios(rows, steps, window_seconds))
