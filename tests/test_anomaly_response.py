"""Anomaly scoring, response planning, policy decisions and the envelope contract."""

from __future__ import annotations

from dataclasses import replace

import pytest
from helpers import download_process, event, events_df
from pyspark.sql import functions as F

from huntframe import catalog
from huntframe.operators import alerts as A
from huntframe.operators import anomaly as M
from huntframe.operators import envelope as E
from huntframe.operators import response as P

SUSPICIOUS = event(
    1, 1, name="Update.exe", cmd="update.exe -EncodedCommand AAA iwr http://x", parent="p", parent_name="winword.exe", pid=5,
)
SUSPICIOUS["process"]["executable"] = "D:\\tmp\\Update.exe"
COMMON = event(2, 1, name="cmd.exe", cmd="cmd.exe /c dir", parent="p", parent_name="explorer.exe", pid=6)


def test_scores_and_reasons(spark):
    rows = {r.seq: r for r in M.score_events(events_df(spark, [SUSPICIOUS, COMMON])).collect()}
    bad, good = rows[1], rows[2]
    assert bad.score == pytest.approx(0.18 + 0.20 + 0.25 + 0.20 + 0.12) and bad.is_anomaly
    assert bad.reasons[0] == "process name is not common: update.exe"
    assert bad.reasons[3] == "suspicious keyword matched: encodedcommand"
    assert bad.features.matched_network_keywords == ["iwr"] and bad.features.executable_directory_depth == 1
    assert (good.score, good.reasons, good.is_anomaly) == (0.0, [], False)


def test_hours_threshold_and_empty_names(spark):
    nameless = event(3, 1, cmd="x", pid=1)
    office = replace(catalog.DEFAULT_BASELINE, normal_hours=(1, 2))
    (r,) = M.score_events(events_df(spark, [nameless]), office, threshold=0.08).collect()
    assert r.reasons == ["hour 10 is outside baseline normal hours"] and r.is_anomaly


def test_unscorable_rows_get_a_reason(spark):
    bad_time = event(5, 1, ts="soon", name="a.exe", cmd="a")
    kept = M.with_features(events_df(spark, [event(4, 3, name="a"), bad_time, COMMON]), on_reject="keep")
    reasons = {r.seq: r.feature_error for r in kept.collect()}
    assert reasons == {4: "wrong_event_code", 5: "bad_timestamp", 2: None}


def test_anomaly_alert(spark):
    alerts = A.anomaly_alerts(M.score_events(events_df(spark, [SUSPICIOUS, COMMON])), "x").collect()
    assert [a.rule.id for a in alerts] == ["ml.process_anomaly"] and alerts[0].ml.score >= 0.7
    assert alerts[0].alert.id.startswith("det-ml-anomaly-process-") and alerts[0].attack is None


def test_baseline_checks(spark, tmp_path):
    bad = spark.createDataFrame([([], [("a", "")], 0.0, 1.0, ["x"], [25])], M.BASELINE_SCHEMA)
    assert {r.violation for r in M.baseline_violations(bad).collect()} == {
        "common_process_names", "allowed_parent_child_pairs", "max_command_line_length", "normal_hours",
    }
    path = tmp_path / "b.json"
    path.write_text(
        '{"common_process_names": ["A.exe"], "allowed_parent_child_pairs": [{"parent": "P", "child": "C"}],'
        ' "max_command_line_length": 5, "max_args_count": 2, "suspicious_keywords": ["NC"]}'
    )
    loaded = M.load_baseline(spark, str(path))
    assert loaded.common_process_names == ("a.exe",) and loaded.allowed_parent_child_pairs == (("p", "c"),)


def shell_alerts(spark, **kw):
    return A.run_engines(events_df(spark, [event(1, 1, name="powershell.exe", cmd="powershell.exe x", **kw)]), "native", "x")


def test_response_plan(spark):
    first = replace(catalog.DEFAULT_PLAYBOOKS[0], id="first", rule_ids=("none",), technique_ids=("T1059.001",))
    plans = P.plan_responses(shell_alerts(spark), (first, *catalog.DEFAULT_PLAYBOOKS), "now").collect()
    assert [p.playbook.id for p in plans] == ["first"] and plans[0].response.severity == "medium"
    assert {a.status for a in plans[0].actions} == {"planned"} and plans[0].response.mode == "dry-run"
    done = replace(first, actions=(catalog.Action("a", "t", "d", status="done"),))
    assert P.plan_responses(shell_alerts(spark), (done,), "now").count() == 0
    assert P.playbook_violations(P.playbooks_df(spark, (done,))).first().violation == "bad:action_status"
    assert P.playbook_violations(P.playbooks_df(spark)).count() == 0


def test_fallback_ids_and_invalid_alerts(spark):
    rows = spark.createDataFrame(
        [("a1", None, "T1"), ("", "r", "T1"), ("a2", None, None)],
        "id string, rule_id_text string, technique string",
    ).select(
        F.struct(F.col("id")).alias("alert"), F.struct(F.col("rule_id_text").alias("id")).alias("rule"),
        F.create_map(F.lit("technique_id"), F.col("technique")).alias("art"),
    )
    errors = P.with_alert_ids(rows).select("alert_id", "technique_id", P.alert_error().alias("e")).collect()
    assert [(r.technique_id, r.e) for r in errors] == [("T1", None), ("T1", "missing_alert_id"), (None, "missing_rule_or_technique")]


@pytest.mark.parametrize(
    "kw,flags,allowed,last_check",
    [
        (dict(pid=5), {}, True, "approved_rule_id"),
        ({}, {}, True, "approved_rule_id"),
        (dict(pid=5), dict(execute=True), False, "lab_allow_execute_missing"),
        (dict(pid=5), dict(execute=True, lab_allow_execute=True), True, "lab_allow_execute"),
        ({}, dict(execute=True, lab_allow_execute=True), False, "lab_allow_execute"),
        ({}, dict(execute=True, lab_allow_execute=True, explicit_pid=9), True, "lab_allow_execute"),
    ],
)
def test_policy(spark, kw, flags, allowed, last_check):
    d = P.decide(shell_alerts(spark, **kw), **flags).first().decision
    assert (d.allowed, d.safety_checks[-1]) == (allowed, last_check)


def test_policy_blocks_and_records(spark):
    alerts = A.run_engines(events_df(spark, [download_process(1, pid=3)]), "native", "x")
    blocked = P.protection_records(P.decide(alerts), "x").first()
    assert blocked.protection.status == "blocked" and blocked.safety.checks[-1] == "unsupported_rule_blocked"
    forced = P.protection_records(P.decide(alerts, force_lab_demo=True), "x").first()
    assert forced.protection.status == "planned" and forced.target.pid == 3
    system = shell_alerts(spark, pid=4).withColumn("process", F.col("process").withField("name", F.lit("LSASS.exe")))
    assert P.decide(system).first().decision.reason == "protected process cannot be killed: LSASS.exe"
    assert P.decide(shell_alerts(spark, pid=-1)).first().decision_error == "bad_pid"
    failed = P.decide(shell_alerts(spark, pid=4)).withColumn(
        "action_result", F.struct(F.lit("kill_process").alias("action"), F.lit(None).cast("string").alias("status"), F.lit("boom").alias("error"))
    )
    assert P.protection_records(failed, "x").first().protection.status == "failed"


def envelope_errors(spark, *values):
    rows = E.parse_envelopes(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    return [r.error_reason for r in rows]


def test_envelope_round_trip_and_errors(spark):
    df = events_df(spark, [event(1, 1, name="a.exe", entity="e1", cmd="a")])
    (text,) = [r.value for r in E.serialize(E.build_envelopes(df, "xml", "t")).collect()]
    checks = {
        text: None,
        text.replace('"1.0"', '"2.0"'): "schema_version",
        text.replace('"event_id":"e1"', '"event_id":""'): "event_id",
        text.replace('"code":1', '"code":"1"'): None,
        text.replace('"code":1', '"code":3'): "event.code",
        text.replace('"source":"xml"', '"source":"live"'): "metadata.source",
        text.replace('"created_at":"t"', '"created_at":""'): "metadata.created_at",
        "[1]": "not_an_object",
        "{broken": "not_json",
    }
    assert envelope_errors(spark, *checks) == list(checks.values())
    parsed = E.parse_envelopes(spark.createDataFrame([(text,), ("x",)], "value string"))
    assert E.valid_events(parsed).first().process.name == "a.exe" and E.rejected_messages(parsed).count() == 1
    with pytest.raises(Exception, match="invalid message"):
        E.valid_events(parsed, fail_fast=True).collect()
