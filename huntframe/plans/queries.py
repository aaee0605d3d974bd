"""The registered queries: each reads the given tables whole and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog, session
from ..functions import ids
from ..functions import scalars as S
from ..functions import timestamps as TS
from ..operators import alerts as A
from ..operators import anomaly as M
from ..operators import coverage as C
from ..operators import dashboard as D
from ..operators import dedupe as U
from ..operators import envelope as E
from ..operators import evaluate as V
from ..operators import normalize as N
from ..operators import realtime as RT
from ..operators import response as P
from ..operators import rules as R
from ..operators import sequences as Q
from ..sources import readers, sinks
from ..sources import telemetry_view as T
from ..streaming import correlator as SC
from ..streaming import evaluation as SE
from ..streaming import live
from ..streaming import pipelines as SP
from ..streaming.versions import Versions
from . import pipelines

CREATED_AT = "2026-01-01T00:00:00Z"
# The test tables are sparse in time, so windows are widened through the window parameter.
SEQUENCE_WINDOW = 86_400
CORRELATION_WINDOW = 21_600
WINDOW_SCALE = 3_600
AS_OF = "2024-01-31 00:00:00"
WIDE_CASES = tuple(replace(c, window_seconds=c.window_seconds * WINDOW_SCALE) for c in catalog.EVALUATION_CASES)


def _joined(c: Column | str, sep: str = ",") -> Column:
    return S.text(F.array_join(c, sep))


def _s(name: str, alias: str) -> Column:
    return S.text(F.col(name)).alias(alias)


# --- normalization and scalars ------------------------------------------------------------------


def normalize_route(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.xml_documents(T.flat_view(spark, sf))
    return N.normalize_xml(docs, keep=("seq",)).select(
        "seq", F.col("event.category")[0].alias("category"), F.col("event.type")[0].alias("type"),
        F.col("event.action").alias("action"), _s("error_reason", "error_reason"),
    )


def xml_events(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.xml_documents(T.flat_view(spark, sf, catalog.SUPPORTED_CODES))
    df = S.where_computed(N.normalize_xml(docs, keep=("seq",)), F.col("error_reason").isNull())
    return df.select(
        "seq", F.col("event.code").cast("bigint").alias("event_code"), F.col("`@timestamp`").alias("timestamp"),
        F.col("host.name").alias("host_name"), F.col("user.domain").alias("user_domain"),
        F.col("user.name").alias("user_name"), F.col("process.pid").alias("pid"),
        F.col("process.entity_id").alias("entity_id"), F.col("process.name").alias("process_name"),
        F.col("process.executable").alias("executable"), _s("process.command_line", "command_line"),
        _joined("process.args", "|").alias("args"),
        S.text(F.element_at("process.hash", "sha256")).alias("sha256"), S.text(F.element_at("process.hash", "md5")).alias("md5"),
        _s("process.parent.name", "parent_name"), _s("event.created", "created"), _s("file.path", "file_path"),
        _s("file.name", "file_name"), _s("file.extension", "file_extension"), _s("registry.path", "registry_path"),
        _s("registry.value", "registry_value"), _joined("registry.data.strings").alias("registry_data"),
        _s("destination.ip", "dest_ip"), F.col("destination.port").alias("dest_port"),
        _s("destination.domain", "dest_domain"), _s("network.transport", "transport"),
        _s("network.direction", "direction"), _joined("tags").alias("tags"),
    )


def message_fields(spark: SparkSession, sf: str) -> DataFrame:
    records = T.log_records(T.flat_view(spark, sf, catalog.SUPPORTED_CODES))
    df = N.normalize_records(records)
    return df.select(
        F.col("winlog.record_id").alias("seq"), F.col("event.code").cast("bigint").alias("event_code"),
        F.col("`@timestamp`").alias("timestamp"), F.col("process.pid").alias("pid"),
        _s("process.name", "process_name"), _s("process.command_line", "command_line"),
        _s("process.entity_id", "entity_id"), _s("file.path", "file_path"), _s("registry.path", "registry_path"),
        _joined("registry.data.strings").alias("registry_data"), _s("destination.ip", "dest_ip"),
        F.col("destination.port").alias("dest_port"), _s("network.transport", "transport"),
        _s("network.direction", "direction"), _s("host.name", "host_name"),
        F.size("sysmon.message_fields").cast("bigint").alias("n_fields"),
    )


def path_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v = T.flat_view(spark, sf)
    return v.select(
        "seq", S.windows_basename(F.col("executable")).alias("base"), S.user_domain(F.col("user_text")).alias("domain"),
        S.user_name(F.col("user_text")).alias("name"), S.windows_basename(F.col("file_path")).alias("file_base"),
        S.file_extension(F.col("file_path")).alias("extension"),
        S.last_backslash_segment(F.col("registry_path")).alias("registry_value"),
    )


def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v = T.flat_view(spark, sf)
    number = F.concat(
        F.col("k").cast("string"), F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, ".5").otherwise(" ")
    )
    hashes = v.withColumn("_h", S.parse_hashes(F.col("hashes"))).withColumn("_a", S.split_command_line(F.col("command_line")))
    return hashes.select(
        "seq", F.size("_a").cast("bigint").alias("n_args"), _joined("_a", "|").alias("args"),
        S.text(F.element_at("_h", "sha256")).alias("sha256"), S.text(F.element_at("_h", "md5")).alias("md5"),
        S.text(S.network_direction(F.col("initiated"))).alias("direction"),
        S.text(F.lower("protocol")).alias("transport"), S.parse_long(number).alias("number"),
        S.directory_depth(F.col("executable")).cast("bigint").alias("depth"),
        S.has_flag(F.col("command_line"), catalog.ENCODED_FLAGS).alias("encoded"),
    )


def timestamp_scalars(spark: SparkSession, sf: str) -> DataFrame:
    v = T.flat_view(spark, sf)
    m, fmt = F.col("seq") % 4, lambda p: F.date_format("raw_ts", p)
    text = (
        F.when(m == 0, fmt("yyyy-MM-dd HH:mm:ss.SSS"))
        .when(m == 1, F.col("stamp"))
        .when(m == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .otherwise(F.lit("n/a"))
    )
    t = F.col("_text")
    return v.withColumn("_text", text).select(
        "seq", S.text(TS.utc_time_to_iso(t)).alias("utc_iso"), TS.normalize_timestamp(t).alias("normalized"),
        TS.own_hour(t).cast("bigint").alias("hour"), F.unix_micros(TS.parse_iso(t)).alias("micros"),
        TS.created_at_text(F.col("raw_ts")).alias("created"),
        TS.event_timestamp(F.lit(""), t).alias("event_timestamp"),
    )


def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.supported_events(spark, sf)
    m = F.col("seq") % 3
    guid = F.map_concat("sysmon.event_data", F.create_map(F.lit("ProcessGuid"), F.concat(F.lit("{"), "process.entity_id", F.lit("}"))))
    ev = ev.withColumn("event", F.col("event").withField("id", F.when(m == 0, F.col("event.id")))).withColumn(
        "sysmon", F.col("sysmon").withField("event_data", F.when(m == 1, guid).otherwise(F.col("sysmon.event_data")))
    )
    return ev.select(
        "seq", ids.event_document_id().alias("document_id"), S.text(ids.envelope_event_id()).alias("envelope_id"),
        TS.index_name(catalog.EVENT_INDEX, F.substring("`@timestamp`", 1, 10)).alias("index_name"),
    )


def raw_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-event form with ingest fields and test metadata; counted per host and tag."""
    ev = N.with_test_metadata(T.supported_events(spark, sf), {"technique_id": "T1059.001", "platform": "windows"}, ("ecs_normalized",))
    raw = N.with_ingest_fields(N.raw_projection(ev))
    return raw.groupBy(
        F.col("host.name").alias("host_name"), F.col("dataset"), F.col("ingest_source"), F.col("tags")[0].alias("tag"),
        F.element_at("art", "technique_id").alias("technique_id"),
    ).agg(F.count("*").alias("n"))


def log_row_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Event-log exports packed as JSON arrays and single objects, decoded and filtered by id and start time."""
    v = T.flat_view(spark, sf).withColumn("_text", F.date_format("raw_ts", "yyyy-MM-dd HH:mm:ss.SSS"))
    row = F.struct(
        F.col("seq").cast("string").alias("RecordId"), F.col("event_code").cast("string").alias("Id"),
        F.col("_text").alias("TimeCreated"), F.col("executable").alias("Message"),
    )
    texts = v.select(
        F.when(F.col("seq") % 2 == 0, F.to_json(row)).otherwise(F.to_json(F.array(row))).alias("value")
    )
    rows = readers.filter_log_rows(readers.decode_log_rows(texts), "2024-01-11T00:00:00Z")
    return rows.select(
        F.col("record_id").alias("seq"), F.col("event_id").cast("bigint").alias("event_code"), "time_created", "message",
        "provider_name", "xml",
    )


def sensor_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.supported_events(spark, sf)
    kept = N.drop_sensor_noise(ev, (*catalog.SENSOR_IMAGES, "C:\\Windows\\System32\\notepad.exe"))
    return kept.groupBy(F.col("process.executable").alias("executable")).agg(F.count("*").alias("n"))


def envelope_validation(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.normalized_events(spark, sf)
    env = E.build_envelopes(ev, "fixture", CREATED_AT)
    env = env.withColumn("seq", F.col("event.event.id").cast("bigint")).withColumn("m", F.col("seq") % 12)
    m = F.col("m")
    meta = lambda f, n, bad: F.when(m == n, F.lit(bad)).otherwise(F.col(f"metadata.{f}"))
    inner = F.when(m != 4, F.col("event.event").withField("dataset", F.when(m == 5, F.lit("other")).otherwise(F.col("event.event.dataset"))))
    broken = env.select(
        "seq", "m",
        F.when(m == 0, F.lit("2.0")).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(m != 1, F.col("event_id")).alias("event_id"),
        F.when(m != 2, F.col("event").withField("event", inner)).alias("event"),
        F.when(
            m != 3,
            F.struct(
                meta("producer", 6, "x").alias("producer"), meta("created_at", 9, "").alias("created_at"),
                meta("source", 7, "live").alias("source"), meta("pipeline_phase", 8, "p").alias("pipeline_phase"),
            ),
        ).alias("metadata"),
    )
    messages = broken.select(
        F.when(m == 10, F.concat(F.lit("broken-"), F.col("seq").cast("string")))
        .otherwise(F.to_json(F.struct("schema_version", "event_id", "event", "metadata")))
        .alias("value")
    )
    parsed = E.parse_envelopes(messages)
    return parsed.groupBy(F.coalesce("error_reason", F.lit("")).alias("error_reason")).agg(
        F.count("*").alias("n"), F.count_distinct(S.text(F.col("event_id"))).alias("ids")
    )


# --- rules ---------------------------------------------------------------------------------------


def _matches(df: DataFrame) -> DataFrame:
    return df.select("seq", "rule_id", _joined("matched_fields").alias("matched_fields"))


def native_rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(R.evaluate(T.supported_events(spark, sf), R.NATIVE_RULES))


def sigma_like_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(R.evaluate(T.supported_events(spark, sf), R.SIGMA_LIKE_RULES))


def multi_branch_rules(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.evaluate(T.supported_events(spark, sf), R.NATIVE_RULES[1:])
    return hits.groupBy(
        "rule_id", F.col("event.code").cast("bigint").alias("event_code"), _joined("matched_fields").alias("matched_fields")
    ).agg(F.count("*").alias("n"))


def alert_documents(spark: SparkSession, sf: str) -> DataFrame:
    alerts = A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT)
    return alerts.select(
        F.col("alert.id").alias("alert_id"), F.col("alert.severity").alias("severity"),
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("rule_name"),
        F.col("attack.technique.id").alias("technique_id"), _joined("attack.tactic").alias("tactic"),
        A.engine_of().alias("engine"), _joined("detection.matched_fields").alias("matched_fields"),
        F.col("host.name").alias("host_name"), F.col("process.name").alias("process_name"),
        F.col("src_doc.document_id").alias("document_id"),
    )


def realtime_rules(spark: SparkSession, sf: str) -> DataFrame:
    alerts = RT.realtime_alerts(T.supported_events(spark, sf))
    return alerts.select(
        F.col("event.id").cast("bigint").alias("seq"), F.col("rule_ord").cast("bigint").alias("rule_ord"),
        F.col("rule.id").alias("rule_id"), _joined("detection.matched_fields").alias("matched_fields"),
        F.col("detection.reason").alias("reason"), "severity", "timestamp",
        D.evidence_summary(F.col("evidence"), F.col("destination.ip"), F.col("destination.port")).alias("evidence"),
    )


def candidate_topk(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.nested_view(T.flat_view(spark, sf, (1,)))
    return R.candidates(ev, tie=F.col("seq")).select("seq", F.col("`@timestamp`").alias("timestamp"), F.col("process.name").alias("process_name"))


def evidence_projection(spark: SparkSession, sf: str) -> DataFrame:
    ev = R.prepare(T.supported_events(spark, sf)).withColumn("_t_text", R.batch_event_text())
    ev = ev.withColumn("_evidence", RT.evidence())
    return ev.select(
        "seq", F.col("_t_text").alias("event_text"),
        _joined(S.present_markers(F.col("_t_text"), catalog.SEQUENCE_CONTEXT_MARKERS)).alias("markers"),
        _joined(F.array_sort(F.map_keys("_evidence"))).alias("evidence_keys"),
        D.evidence_summary(F.col("_evidence"), F.col("destination.ip"), F.col("destination.port")).alias("summary"),
    )


# --- sequences and correlation -------------------------------------------------------------------


def _sequence_rows(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("detection.sequence_name").alias("sequence_name"), F.col("host.name").alias("host_name"),
        _joined("detection.sequence_steps").alias("steps"), _joined("src_doc.document_ids").alias("documents"),
        F.col("alert.created").alias("created"), F.col("process.name").alias("process_name"),
        F.col("detection.correlated_event_count").cast("bigint").alias("n"),
    )


def sequence_process_network_file(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence_rows(Q.behavioral_alerts(T.supported_events(spark, sf), Q.SEQUENCES[:1], SEQUENCE_WINDOW))


def sequence_with_optional(spark: SparkSession, sf: str) -> DataFrame:
    return _sequence_rows(Q.behavioral_alerts(T.supported_events(spark, sf), Q.SEQUENCES[1:], SEQUENCE_WINDOW))


def host_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return Q.host_ordinals(T.supported_events(spark, sf)).select("seq", F.col("host.name").alias("host_name"), "host_ord")


def sequence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """All matched sequences, numbered over hosts and definitions."""
    alerts = Q.behavioral_alerts(T.supported_events(spark, sf), window_seconds=SEQUENCE_WINDOW).select(
        F.col("host.name").alias("host_name"), F.col("detection.sequence_name").alias("sequence_name"),
        F.col("src_doc.document_ids")[0].cast("bigint").alias("anchor"),
    )
    return Q.running_numbers(alerts, ("host_name", "sequence_name", "anchor"), "number")


def correlate_batch(spark: SparkSession, sf: str) -> DataFrame:
    return RT.correlate(T.supported_events(spark, sf), CORRELATION_WINDOW).select(
        "process_id", "network_id", "file_id", "timestamp", "rule_id"
    )


def correlated_alert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The correlator's alerts as full documents."""
    ev = T.supported_events(spark, sf)
    docs = RT.correlated_alert_documents(RT.correlate(ev, CORRELATION_WINDOW), ev)
    return docs.select(
        F.col("alert.id").alias("alert_id"), "timestamp", "severity", F.col("rule.id").alias("rule_id"), F.col("attack.technique.id").alias("technique_id"),
        _joined("detection.matched_fields").alias("matched_fields"), F.col("detection.correlated_event_count").cast("bigint").alias("n"),
        _joined("source_event_ids").alias("source_event_ids"), _joined(F.transform("related_events", lambda e: e["event"]["code"])).alias("codes"),
        F.col("source_event.id").alias("source_event"), F.col("host.name").alias("host_name"), F.col("process.name").alias("process_name"),
        F.col("file.path").alias("file_path"), _joined(F.array_sort(F.map_keys("evidence"))).alias("evidence_keys"),
        F.col("related_events")[0]["evidence"]["process.command_line"].alias("first_command_line"),
    )


def correlate_host_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return RT.correlate(T.supported_events(spark, sf), SEQUENCE_WINDOW, host_scoped=True).select(
        "process_id", "network_id", "file_id", "timestamp"
    )


# --- anomaly -------------------------------------------------------------------------------------


def anomaly_features(spark: SparkSession, sf: str) -> DataFrame:
    df = M.with_features(T.nested_view(T.flat_view(spark, sf, (1,))))
    f = lambda n: F.col(f"features.{n}")
    big = lambda n: f(n).cast("bigint").alias(n)
    return df.select(
        "seq", f("process_name").alias("process_name"), f("parent_process_name").alias("parent_process_name"),
        big("command_line_length"), big("args_count"), big("executable_directory_depth"), f("has_encoded_command").alias("has_encoded_command"),
        f("has_network_tool_flag").alias("has_network_tool_flag"),
        _joined(f("matched_network_keywords")).alias("matched_network_keywords"), big("hour_of_day"),
    )


# A baseline with office hours, so that the hour check takes part.
OFFICE_BASELINE = replace(catalog.DEFAULT_BASELINE, normal_hours=tuple(range(6, 20)))


def anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = M.score_events(T.nested_view(T.flat_view(spark, sf, (1,))), OFFICE_BASELINE)
    return df.select("seq", "score", "is_anomaly", _joined("reasons", "; ").alias("reasons"))


def anomaly_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """All events by why they cannot be scored."""
    df = M.with_features(T.nested_view(T.flat_view(spark, sf, catalog.SUPPORTED_CODES)), on_reject="keep")
    return df.groupBy(_s("feature_error", "reason")).agg(F.count("*").alias("n"))


def anomaly_alerts(spark: SparkSession, sf: str) -> DataFrame:
    scored = M.score_events(T.nested_view(T.flat_view(spark, sf, (1,))))
    return A.anomaly_alerts(scored, CREATED_AT).select(
        F.col("src_doc.document_id").alias("document_id"), F.col("rule.id").alias("rule_id"),
        F.col("detection.engine").alias("engine"), F.col("ml.score").alias("score"),
        F.size("ml.reasons").cast("bigint").alias("n_reasons"),
    )


# --- response and policy -------------------------------------------------------------------------

PLAYBOOKS = (
    *catalog.DEFAULT_PLAYBOOKS,
    catalog.Playbook(
        "playbook.review", "Review", "Review persistence and transfer alerts.",
        ("det.t1547_001.registry_run_key_persistence",), ("T1105", "T1059.001"),
        (catalog.Action("review", "recommendation", "Review the alert."),),
    ),
)


def response_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = P.plan_responses(A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT), PLAYBOOKS, CREATED_AT)
    return plan.select(
        F.col("response.id").alias("response_id"), F.col("response.severity").alias("severity"),
        F.col("response.status").alias("status"), F.col("alert.id").alias("alert_id"),
        F.col("alert.rule_id").alias("rule_id"), F.col("alert.technique_id").alias("technique_id"),
        F.col("playbook.id").alias("playbook_id"), _joined(F.transform("actions", lambda a: a["id"])).alias("actions"),
    )


def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions without and with execution, from one run of the rules."""
    alerts = A.run_engines(T.supported_events(spark, sf), "native", CREATED_AT)
    both = alerts.withColumn("_run", F.explode(F.array(F.lit(False), F.lit(True))))
    return P.protection_records(P.decide(both, F.col("_run"), F.col("_run")), CREATED_AT).groupBy(
        F.col("protection.mode").alias("mode"), F.col("protection.status").alias("status"),
        F.col("protection.reason").alias("reason"), _joined("safety.checks").alias("checks"),
    ).agg(F.count("*").alias("n"), F.count_distinct("target.pid").alias("pids"))


def response_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts by why no response can be planned; some have lost their id, their rule or also their technique."""
    alerts = A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT)
    kind = F.pmod(F.col("src_doc.document_id").cast("bigint"), F.lit(4))
    lost = lambda name, field, when: F.when(when, F.col(name).withField(field, F.lit(None).cast("string"))).otherwise(F.col(name))
    damaged = alerts.withColumns(
        {
            "alert": lost("alert", "id", kind == 1),
            "rule": lost("rule", "id", kind >= 2),
            "attack": F.when(kind == 3, F.lit(None)).otherwise(F.col("attack")),
        }
    )
    return P.with_alert_ids(damaged).groupBy(S.text(P.alert_error()).alias("reason")).agg(F.count("*").alias("n"))


# --- cases ---------------------------------------------------------------------------------------


def _case_id(user: Column, seq: Column) -> Column:
    return F.concat(F.lit("case_"), (user * 7 + seq % 7).cast("string"))


ENGINE_CASES = 60


def case_matrix_engines(spark: SparkSession, sf: str) -> DataFrame:
    """A case matrix whose cases name their engine, all four of them, with planned responses and failed cases.

    A case holds the events of some users; most cases of the anomaly engine hold process events only, the others fail.
    """
    raw = T.read_events(spark, sf, catalog.SUPPORTED_CODES)
    number = lambda user: user % ENGINE_CASES
    engine = lambda no: F.element_at(S.str_array(catalog.CASE_ENGINES), (no % 5 + 1).cast("int"))
    name = lambda no: F.concat(F.lit("engine_case_"), no.cast("string"))
    no = F.col("no")
    cases = raw.select(number(F.col("user_id")).alias("no")).distinct().select(
        name(no).alias("case_id"), engine(no).alias("engine"), (no % 3 != 0).alias("expected_alert")
    )
    ev = T.nested_view(T.flat_view(spark, sf, catalog.SUPPORTED_CODES))
    ev = ev.withColumn("no", number(F.regexp_extract("user.name", r"(\d+)$", 1).cast("bigint")))
    ev = ev.where((engine(no) != "ml-anomaly") | (no % 3 == 0) | (F.col("event.code") == 1)).withColumn("case_id", name(no)).drop("no")
    rows = pipelines.run_case_matrix(cases, ev, playbooks=PLAYBOOKS, window_seconds=SEQUENCE_WINDOW)
    sorted_text = lambda c: _joined(F.array_sort(c)).alias(c)
    return rows.select(
        "case_id", "engine", "status", _s("error", "error"), "expected_alert", "classification", "alert_count", "response_count", "correlated_sequence_count",
        "normalized_event_count", sorted_text("actual_rule_ids"), sorted_text("actual_engines"), sorted_text("actual_sequence_names"),
        _s("event_code", "event_code"),
    )


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labelled cases over the telemetry: groups of a user's events, their alerts, their events and the responses planned for them."""
    raw = T.read_events(spark, sf, catalog.SUPPORTED_CODES)
    number = F.col("user_id") * 7 + F.col("event_id") % 7
    n = F.col("no")
    techniques = ("T1059.001", "T1105", "T1547.001", "T1218", "T9999")
    cases = raw.select(number.alias("no")).distinct().select(
        F.concat(F.lit("case_"), n.cast("string")).alias("case_id"),
        n.alias("case_ord"),
        F.element_at(S.str_array(techniques), (n % 5 + 1).cast("int")).alias("technique_id"),
        (n % 3 != 0).alias("expected_alert"),
        F.when(n % 4 == 0, "dry-run").when(n % 4 == 1, "none").otherwise("").alias("expected_protection"),
        (n % 8 == 0).alias("expected_response"),
    )
    flat = T.flat_view(spark, sf, catalog.SUPPORTED_CODES)
    ev = T.nested_view(flat)
    user = F.regexp_extract("user.name", r"(\d+)$", 1).cast("bigint")
    ev = ev.withColumn("case_id", _case_id(user, F.col("seq")))
    rules = R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES)
    engines = F.create_map(*[F.lit(x) for r in R.SIGMA_LIKE_RULES for x in (r.rule_id, r.engine)])
    alerts = R.evaluate(ev, rules).select(
        "case_id", (F.col("seq") * 10 + F.col("rule_ord")).alias("ord"), "rule_id",
        F.element_at(engines, F.col("rule_id")).alias("engine"), F.lit(None).cast("string").alias("sequence_name"),
    )
    technique = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.technique_id)]), F.col("rule_id"))
    responses = S.where_computed(alerts, P.is_planned(F.col("rule_id"), technique, PLAYBOOKS)).select("case_id")
    events = ev.select("case_id", F.col("seq").alias("ord"), F.col("event.code").alias("event_code"))
    return cases, alerts, events, responses


def _case_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.case_rows(*_cases(spark, sf))


def case_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _case_rows(spark, sf).select(
        "case_id", "technique_id", "expected_alert", "actual_alert", "classification", "alert_count",
        "normalized_event_count", "response_count", _joined("actual_rule_ids").alias("actual_rule_ids"),
        _joined("actual_engines").alias("actual_engines"), _s("event_code", "event_code"),
    )


def case_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return V.dashboard_counts(_case_rows(spark, sf))


def technique_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = session.cut_lineage(_case_rows(spark, sf).withColumn("indexed_response_count", F.col("response_count")))
    stored = _stored(spark, "alerts", Q.behavioral_alerts(T.supported_events(spark, sf), window_seconds=SEQUENCE_WINDOW), sinks.write_alerts)
    agg = C.aggregate_techniques(C.covered_techniques(spark), C.rule_inventory(spark), rows, C.stored_sequences(stored))
    layer = C.navigator_rows(agg).select("technique_id", "color", F.col("tactic").alias("slug"), "comment", "rank", "metadata")
    return agg.join(layer, "technique_id").select(
        "technique_id", "technique_name", _joined("tactic").alias("tactic"), _joined("engines").alias("engines"),
        _joined("rule_ids").alias("rule_ids"), _joined("telemetry_event_ids", "/").alias("event_ids"),
        "demo_case_count", "true_positive_count", "false_positive_count", "false_negative_count", "sequence_count",
        "has_response_or_protection", F.col("score").cast("bigint").alias("score"), "color", "slug", "comment",
        F.col("rank").cast("bigint").alias("rank"), F.size("metadata").cast("bigint").alias("n_metadata"),
    )


def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """The coverage report over the telemetry: each engine must fire all its rules."""
    ev = T.supported_events(spark, sf)
    inventory = C.rule_inventory(spark)
    single = R.evaluate(ev, R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES)).select("rule_id")
    fired = single.unionByName(Q.behavioral_alerts(ev, window_seconds=SEQUENCE_WINDOW).select(F.col("rule.id").alias("rule_id")))
    actual = fired.join(F.broadcast(inventory.select("rule_id", "engine")), "rule_id").groupBy(F.col("engine").alias("name"), "rule_id").agg(F.count("*").alias("n"))
    checks = V.containment_checks(inventory.select(F.col("engine").alias("name"), "rule_id"), actual)
    report = C.coverage_report(spark, checks, CREATED_AT)
    each = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), ";")
    check = lambda v: F.concat_ws(":", v["name"], v["required_count"].cast("string"), v["missing_count"].cast("string"), v["actual_alert_count"].cast("string"), v["passed"].cast("string"))
    return report.select(
        "generated_at", F.size("covered_techniques").cast("bigint").alias("n_techniques"), each("rule_inventory", lambda r: r["rule_id"]).alias("rules"),
        F.col("engine_coverage_summary.total_rule_count").alias("total_rule_count"), each("validation_results", check).alias("validations"), "all_passed",
    )


def engine_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rules per engine, and how many of them fired how often over the telemetry."""
    rules = R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES)
    fired = R.evaluate(T.supported_events(spark, sf), rules).groupBy("rule_id").agg(F.count("*").alias("n"))
    inventory = C.rule_inventory(spark).join(fired, "rule_id", "left")
    return inventory.groupBy("engine").agg(
        F.count("*").alias("rule_count"), F.count_if(F.col("n").isNotNull()).alias("fired_rule_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("alert_count"), F.count_distinct("technique_id").alias("technique_count"),
    )


def filtered_alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT)
    one = C.filtered_alert_counts(alerts)
    wide = one.select(
        F.explode(
            F.array(
                *[F.struct(F.lit("t1059").alias("kind"), F.lit(c).alias("key"), F.col(f"{c}_count").alias("n"))
                  for c in ("total", "native", "sigma_like")]
            )
        ).alias("r")
    ).select("r.*")
    return wide.unionByName(C.rule_and_engine_counts(alerts))


def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.supported_events(spark, sf)
    return C.collection_counts(
        spark,
        {
            catalog.EVENT_INDEX: ev,
            catalog.RAW_INDEX: T.read_events(spark, sf),
            catalog.ALERT_INDEX: R.evaluate(ev, R.NATIVE_RULES),
        },
    )


def case_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the matrix; a stored number is taken before a counted one, unless it is zero."""
    stored = spark.range(1).selectExpr(
        "7L total_cases", "0L true_positive_count", "0L true_negative_count", "0L false_positive_count", "cast(null as bigint) false_negative_count"
    )
    return C.case_matrix_totals(_case_rows(spark, sf), stored)


def capability_report(spark: SparkSession, sf: str) -> DataFrame:
    """Capabilities with the status of the checks they rest on: cases of each engine that all ended as expected."""
    rows = case_matrix_engines(spark, sf)
    checks = rows.groupBy(F.col("engine").alias("id")).agg(
        F.when(F.bool_and(F.col("status") == "passed"), F.lit("passed")).otherwise(F.lit("failed")).alias("status")
    )
    capabilities = spark.createDataFrame(
        [("rules", ["native", "sigma-like", "all"]), ("sequences", ["behavioral"]), ("anomaly", ["ml-anomaly"]), ("everything", list(catalog.CASE_ENGINES)),
         ("unknown", ["not-run"]), ("plain", [])],
        "capability string, validation_ids array<string>",
    )
    return C.capability_status(capabilities, checks)


def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = session.cut_lineage(_case_rows(spark, sf))
    tag = lambda m, df: df.select(F.lit(m).alias("metric"), "key", "n")
    rules = rows.select("case_id", F.explode("actual_rule_ids").alias("rule_id"))
    severities = D.highest_severity(rules, C.rule_inventory(spark))
    parts = (
        tag("severity", D.zero_fill(D.count_by(severities, F.col("severity")), catalog.SEVERITIES)),
        tag("engine", D.zero_fill(D.count_engines(rows), catalog.DASHBOARD_ENGINES)),
        tag("event_code", D.count_event_codes(rows)),
        tag("technique", D.zero_fill(D.count_by(rows, F.col("technique_id")), catalog.TECHNIQUE_ORDER)),
    )
    return Q.union_alerts(*parts)


def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the cases, and what the stored alerts of all engines name: rules, techniques and sequences."""
    ev = T.supported_events(spark, sf)
    alerts = A.run_engines(ev, "all", CREATED_AT).unionByName(Q.behavioral_alerts(ev, window_seconds=SEQUENCE_WINDOW), True)
    stored = _stored(spark, "alerts", alerts, sinks.write_alerts).select(
        F.col("rule.id").alias("rule_id"), F.col("attack.technique.id").alias("technique_id"), F.col("detection.sequence_name").alias("sequence_name")
    )
    return D.totals(_case_rows(spark, sf), C.rule_inventory(spark), C.covered_techniques(spark)).join(
        D.distinct_counts(stored).select(
            F.col("rule_count").alias("fired_rules"), F.col("technique_count").alias("fired_techniques"), F.col("sequence_alert_count").alias("sequence_alerts")
        ),
        on=F.lit(True),
    )


def dashboard_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard rows joined to their case detail, with rule severity and display fallbacks."""
    rows = session.cut_lineage(_case_rows(spark, sf))
    slim = rows.select("case_id", "technique_id", "classification", "alert_count", "actual_rule_ids", "event_code", "expected_alert")
    detail = rows.select("case_id", "technique_id", "expected_protection")
    return D.case_view(slim, detail, C.rule_inventory(spark)).select(
        "case_id", "technique_id", "classification", "alert_count", "event_code", "severity", "process",
        "expected_malicious", "expected_protection",
    )


def expected_rule_checks(spark: SparkSession, sf: str) -> DataFrame:
    cases, alerts, *_ = _cases(spark, sf)
    wanted = cases.where("expected_alert").select(
        "case_id", F.lit("det.t1105.lolbin_download").alias("rule_id"), F.lit(2).cast("bigint").alias("expected_count")
    )
    return V.rule_id_checks(wanted, alerts)


def unknown_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Case ids among all events that no process event belongs to."""
    case = lambda df: df.select(_case_id(F.col("user_id"), F.col("event_id")).alias("case_id"))
    return V.unknown_case_ids(case(T.read_events(spark, sf, (1,))).distinct(), case(T.read_events(spark, sf)))


# --- realtime evaluation and dashboard ----------------------------------------------------------


def _evaluation(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marker sightings in any event and in any realtime alert's own document, with their case columns."""
    prepared = R.prepare(events).withColumn("_hay", R.evaluation_event_text())
    docs = prepared.select("ts", F.col("event.id").alias("event_id"), "_hay")
    sightings = V.matching_cases(docs, F.col("_hay"), WIDE_CASES)
    alerts = RT.realtime_alerts(events, keep=("ts",)).select(
        "ts", F.col("alert.id").alias("alert_id"), F.col("rule.id").alias("rule_id"), R.evaluation_alert_text().alias("_hay")
    )
    return sightings, V.matching_cases(alerts, F.col("_hay"), WIDE_CASES)


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    """What shows a marker, written once: it is selective, and episodes and links read it several times."""
    return session.cut_lineage(V.activity(*_evaluation(T.supported_events(spark, sf))))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return V.episodes_of(_activity(spark, sf), F.lit(AS_OF).cast("timestamp"))


def _micros_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def episode_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(spark, sf).select(
        "case_id", "episode", "status", "classification", _micros_text("first_seen").alias("first_seen"),
        _micros_text("last_seen").alias("last_seen"), "event_count", "alert_count", "actual_rule_ids",
    )


def case_classification(spark: SparkSession, sf: str) -> DataFrame:
    cases = V.case_table(spark, WIDE_CASES).drop("expected_rule_ids", "window_seconds", "marker")
    states = V.latest_states(_episodes(spark, sf), cases)
    return states.select("case_id", "technique_id", "expected_alert", "status", "classification", "event_count", "alert_count", "actual_rule_ids")


def evaluation_counts(spark: SparkSession, sf: str) -> DataFrame:
    cases = V.case_table(spark, WIDE_CASES).drop("expected_rule_ids", "window_seconds", "marker")
    return V.state_counts(V.latest_states(_episodes(spark, sf), cases))


def _realtime_flat(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("attack.technique.id").alias("technique_id"), F.col("detection.engine").alias("engine"), "severity", "timestamp"
    )


def realtime_summary(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.supported_events(spark, sf)
    events = ev.select(F.col("event.code").cast("string").alias("event_code"), RT.timestamp().alias("timestamp"))
    return D.summary(events, _realtime_flat(RT.realtime_alerts(ev)))


def count_maps(spark: SparkSession, sf: str) -> DataFrame:
    return D.count_maps(V.dashboard_counts(_case_rows(spark, sf)).where(~F.col("metric").isin("total", "classification")))


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.supported_events(spark, sf)
    kept = D.latest(ev.select("seq", "ts", F.col("`@timestamp`").alias("timestamp"), F.col("event.code").cast("bigint").alias("event_code")), catalog.REALTIME_EVENT_LIMIT, "ts")
    return kept.select("seq", "timestamp", "event_code")


def alert_case_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Realtime alerts with the first case whose last episode holds the alert's id or its rule's."""
    ev = T.supported_events(spark, sf)
    alerts = RT.realtime_alerts(ev).select(
        F.col("alert.id").alias("alert_id"), F.concat(F.col("event.id"), F.lit("-"), F.col("rule_ord").cast("string")).alias("label"),
        F.col("rule.id").alias("rule_id"), F.col("attack.technique.id").alias("technique_id"),
        F.col("detection.engine").alias("engine"), "severity", F.col("process.name").alias("process_name"),
        F.col("event.code").alias("event_code"), "timestamp",
    )
    cases = V.case_table(spark, WIDE_CASES).drop("expected_rule_ids", "window_seconds", "marker")
    activity = _activity(spark, sf)
    states = V.latest_states(V.episodes_of(activity, F.lit(AS_OF).cast("timestamp")), cases)
    links = session.cut_lineage(V.last_links(session.cut_lineage(V.episode_links(activity))))
    table = D.alert_table(alerts, D.observed_states(states), links, ("label",))
    return table.select(F.col("label").alias("alert_id"), "classification", "rule_id", "severity", "process", "event_code", "expected_alert", _s("case_id", "case_id"))


def _link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("case_id", "episode", "kind").agg(F.count("*").alias("n"))


def episode_links(spark: SparkSession, sf: str) -> DataFrame:
    """How many events, alerts and rules each episode is linked with."""
    return _link_counts(V.episode_links(_activity(spark, sf)))


def untimed_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Events without a readable time that the evaluation or the correlator would otherwise use, by what they lack it for."""
    ev = T.supported_events(spark, sf)
    cases = V.untimed(_activity(spark, sf)).select(F.concat(F.lit("evaluation_"), "kind").alias("consumer"), "reason", "case_id")
    keyed = RT.correlation_rejects(ev).select(F.lit("correlation").alias("consumer"), "reason", F.coalesce("step", F.lit("none")).alias("case_id"))
    return cases.unionByName(keyed).groupBy("consumer", "reason", F.col("case_id").alias("of")).agg(F.count("*").alias("n"))


def dedupe_records(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.read_events(spark, sf).withColumn("record_id", F.floor(F.col("event_id") / 2))
    return U.first_by(raw, "record_id", F.col("event_id")).select("record_id", "event_id", "user_id", "event_type")


def distinct_realtime_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Realtime alerts, each id once; label and rule matches of one event share an id."""
    alerts = RT.distinct_alerts(RT.realtime_alerts(T.supported_events(spark, sf)))
    return alerts.select(F.col("event.id").cast("bigint").alias("seq"), F.col("rule.id").alias("rule_id"), F.col("detection.reason").alias("reason"))


def daily_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Events written to daily tables by id, twice as after a replay, and counted back per day."""
    path = session.scratch_path(spark, "daily-events")
    ev = T.supported_events(spark, sf).select("seq", "ts", "`@timestamp`", "event", "host", "process", "sysmon")
    for _ in range(2):
        sinks.write_events(ev, path, F.col("ts").cast("date"))
    # rows without an id of their own stay apart, and writing them again adds none
    nameless = ev.where(F.col("seq") % 500 == 0)
    sinks.upsert_daily(nameless, path, F.lit(None).cast("string"), F.lit("2001-01-01").cast("date"))
    sinks.upsert_daily(nameless, path, F.lit(None).cast("string"), F.lit("2001-01-01").cast("date"))
    # a later batch that touches the rows without a day only
    sinks.write_events(ev.where(F.col("ts").isNull()), path, F.col("ts").cast("date"))
    back = readers.read_event_table(spark, path)
    return back.groupBy(F.date_format("index_date", TS.INDEX_DATE).alias("day")).agg(
        F.count("*").alias("n"), F.sum("seq").alias("seq_sum")
    )


def _stored(spark: SparkSession, label: str, df: DataFrame, write: Callable) -> DataFrame:
    """Documents written to a daily table twice, as after a replay, and read back."""
    path = session.scratch_path(spark, label)
    for _ in range(2):
        write(df, path, F.lit(CREATED_AT).cast("timestamp").cast("date"))
    return readers.read_event_table(spark, path)


def written_alerts(spark: SparkSession, sf: str) -> DataFrame:
    back = _stored(spark, "alerts", A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT), sinks.write_alerts)
    return back.groupBy(F.col("rule.id").alias("rule_id"), F.col("alert.severity").alias("severity")).agg(F.count("*").alias("n"))


def written_responses(spark: SparkSession, sf: str) -> DataFrame:
    plan = P.plan_responses(A.run_engines(T.supported_events(spark, sf), "all", CREATED_AT), PLAYBOOKS, CREATED_AT)
    back = _stored(spark, "responses", plan, sinks.write_responses)
    return back.groupBy(F.col("playbook.id").alias("playbook_id"), F.col("alert.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def written_protection(spark: SparkSession, sf: str) -> DataFrame:
    records = P.protection_records(P.decide(A.run_engines(T.supported_events(spark, sf), "native", CREATED_AT)), CREATED_AT)
    back = _stored(spark, "protection", records, sinks.write_protection)
    return back.groupBy(F.col("protection.mode").alias("mode"), F.col("protection.status").alias("status")).agg(F.count("*").alias("n"))


def xml_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's document, each eighth of them damaged in another way, with the reason it is rejected for."""
    xml, kind = F.col("xml"), F.col("seq") % 8
    damaged = (
        F.when(kind == 1, F.concat(xml, xml))
        .when(kind == 2, F.concat(xml, F.lit(" tail")))
        .when(kind == 3, F.replace(xml, F.lit("</System>"), F.lit("")))
        .when(kind == 4, F.regexp_replace(xml, "<EventID>.*</EventID>", "<EventID>99999999999</EventID>"))
        .when(kind == 5, F.regexp_replace(xml, "<Computer>.*</Computer>", ""))
        .when(kind == 6, F.regexp_replace(xml, '<Data Name="ProcessId">[^<]*</Data>', '<Data Name="ProcessId">x1</Data>'))
        .when(kind == 0, F.concat(xml, F.lit("\n<!-- end </Event> -->")))
    )
    # Every third document of the second sort has another tail that a parser of the first element would not see.
    damaged = F.when(
        (kind == 2) & (F.col("seq") % 3 > 0), F.concat(xml, F.when(F.col("seq") % 3 == 1, F.lit("<x/>")).otherwise(F.lit("junk/>")))
    ).otherwise(damaged)
    docs = T.xml_documents(T.flat_view(spark, sf, catalog.SUPPORTED_CODES)).select("seq", damaged.alias("xml"))
    return N.normalize_xml(docs, keep=("seq",)).select("seq", "error_reason")


# --- streaming -----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return T.nested_view(T.event_stream(spark, sf))


def stream_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return SC.drain_correlation(_stream(spark, sf), CORRELATION_WINDOW, 6 * 3600).select(
        "process_id", "network_id", "file_id", "timestamp", "rule_id"
    )


def stream_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    sightings, alerts = _evaluation(_stream(spark, sf))
    rows = SE.evaluation_input(sightings, alerts)
    with SP.state_store(spark, spark.sparkContext.defaultParallelism):
        emitted = SP.drain_batches(SE.track_cases(rows), "evaluation")
    return SE.newest_states(emitted).select(
        "case_id", "episode", "classification", _micros_text("first_seen").alias("first_seen"),
        _micros_text("last_seen").alias("last_seen"), "event_count", "alert_count", "actual_rule_ids",
    )


def stream_episode_links(spark: SparkSession, sf: str) -> DataFrame:
    """``episode_links`` from a stream: the tracker places time slices in episodes, the ids go around it."""
    sightings, alerts = _evaluation(_stream(spark, sf))
    with SP.state_store(spark, spark.sparkContext.defaultParallelism):
        emitted = SP.drain_batches(SE.track_cases(SE.evaluation_input(sightings, alerts)), "evaluation")
    ids = SP.drain(SE.link_ids(sightings, alerts), "link-ids")
    return _link_counts(SE.links(emitted, ids))


def stream_rules_summary(spark: SparkSession, sf: str) -> DataFrame:
    alerts = SP.detect_stream(_stream(spark, sf))
    counts = alerts.groupBy(F.col("rule.id").alias("rule_id"), "severity").agg(F.count("*").alias("n"))
    batches = SP.drain_batches(counts, "rules-summary", "complete")
    last = batches.groupBy("rule_id", "severity").agg(F.max_by("n", "batch_id").alias("n"))
    return last


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of the rules and the correlator from a stream, each id once."""
    base = session.scratch_path(spark, "live-alerts")
    log = live.AlertLog(base, SC.Correlator(f"{base}/correlator", CORRELATION_WINDOW, 6 * 3600), 31 * 86_400)
    live.run_jobs(_stream(spark, sf), f"{base}/checkpoint", log).awaitTermination()
    return log.alerts(spark).select("rule_id", "engine", "severity", "timestamp", _joined("source_event_ids").alias("source_event_ids"))


def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """``realtime_summary`` from a stream."""
    base = session.scratch_path(spark, "live-summary")
    summary = live.LiveSummary(base)
    live.run_jobs(_stream(spark, sf), f"{base}/checkpoint", summary).awaitTermination()
    return summary.rows(spark)


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest events and alerts of a stream: those kept, and of the events those shown."""
    base = session.scratch_path(spark, "live-latest")
    events, alerts = live.latest_events(base), live.latest_alerts(base)
    live.run_jobs(_stream(spark, sf), f"{base}/checkpoint", events, alerts).awaitTermination()
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "seq", "timestamp", (F.col("rule_id") if "rule_id" in df.columns else F.lit("")).alias("rule_id"))
    return Q.union_alerts(
        kind("kept_event", events.rows(spark)), kind("shown_event", events.rows(spark, catalog.SHOWN_EVENT_LIMIT)), kind("alert", alerts.rows(spark))
    )


def stream_record_order(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose files arrive in another order than their times, released in record order: how many, and how many out of order."""
    base = session.scratch_path(spark, "live-order")
    raw = T.read_events(spark, sf)
    days = F.datediff("ts", F.lit("2024-01-01"))
    for n, part in enumerate((1, 0, 2)):  # a file holds every third day, so late days come before early ones
        raw.where(F.pmod(days, F.lit(3)) == part).select(F.col("event_id").alias("record_id"), "ts").coalesce(1).write.parquet(f"{base}/in/part-{n}")
    stream = spark.readStream.schema("record_id bigint, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    released = Versions(f"{base}/released", "record_id bigint, ts timestamp, place bigint")
    # the partitions of a sorted batch follow each other, and so do the numbers inside them
    keep = lambda batch, n: released.write(batch.withColumn("place", F.monotonically_increasing_id()), n)
    ordered = live.OrderedRelease(f"{base}/order", stream.schema, keep, 31 * 86_400)
    live.run_jobs(stream, f"{base}/checkpoint", ordered).awaitTermination()
    ordered.finish(spark)
    later = F.lag("record_id").over(Window.partitionBy("batch_id", F.shiftright("place", 33)).orderBy("place"))
    checked = released.all(spark).withColumn("late", later > F.col("record_id"))
    return checked.agg(F.count("*").alias("n"), F.count_if("late").alias("out_of_order"))


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    v = T.event_stream(spark, sf).withColumns({"record_id": F.floor(F.col("seq") / 2), "ts": F.col("raw_ts")})
    records = SP.distinct_records(v.select("record_id", "ts"), watermark="31 days")
    return SP.drain(records, "dedupe").select("record_id")


def stream_series(spark: SparkSession, sf: str) -> DataFrame:
    v = T.event_stream(spark, sf).withColumn("ts", F.col("raw_ts")).select("ts", F.col("event_code").cast("bigint").alias("event_code"))
    drained = SP.drain_batches(SP.series(v, "1 day"), "series", "update")
    return drained.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_code").agg(F.max("n").alias("n"))


def stream_consume(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes written to a directory topic and replayed as a stream through detection."""
    topic = session.scratch_path(spark, "topic")
    ev = T.nested_view(T.flat_view(spark, sf, (1,)))
    sinks.write_message_files(E.serialize(E.build_envelopes(ev, "fixture", CREATED_AT)), topic)
    alerts = SP.consume_and_detect(readers.envelope_directory(spark, topic), "all", CREATED_AT)
    out = SP.drain(alerts.select(F.col("rule.id").alias("rule_id"), F.col("host.name").alias("host_name")), "consumed")
    return out.groupBy("rule_id", "host_name").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_route, xml_events, message_fields, path_scalars, text_scalars, timestamp_scalars, document_ids,
        raw_projection, log_row_decode, sensor_exclusion, envelope_validation, native_rule_matches,
        sigma_like_matches, multi_branch_rules, alert_documents, realtime_rules, candidate_topk, evidence_projection,
        sequence_process_network_file, sequence_with_optional, host_ordinals, sequence_numbers, correlate_batch, correlated_alert_documents, correlate_host_scoped,
        anomaly_features, anomaly_scores, anomaly_rejects, anomaly_alerts, response_plan, response_rejects, policy_decisions, case_matrix, case_matrix_engines, case_dashboard,
        technique_coverage, coverage_report, case_totals, capability_report, engine_summary, filtered_alert_counts, collection_counts, zero_filled_counts,
        dashboard_totals, dashboard_rows, expected_rule_checks, unknown_cases, episode_sessions, case_classification,
        evaluation_counts, realtime_summary, count_maps, latest_events, alert_case_lookup, episode_links, untimed_activity, dedupe_records,
        distinct_realtime_alerts, daily_upsert, written_alerts, written_responses, written_protection, xml_rejects, stream_correlation, stream_evaluation,
        stream_episode_links, stream_alerts, stream_summary, stream_latest, stream_record_order, stream_rules_summary,
        stream_dedupe, stream_series, stream_consume,
    )
}
