"""Single-event rules, realtime rules and alert documents."""

from __future__ import annotations

import pytest
from helpers import (
    download_file, download_network, download_process, event, events_df, proxy_process, run_key_process, run_key_write,
)
from pyspark.sql import functions as F

from huntframe.operators import alerts as A
from huntframe.operators import realtime as RT
from huntframe.operators import rules as R


def fired(spark, docs, rules):
    rows = R.evaluate(events_df(spark, docs), rules).select("seq", "rule_id", "matched_fields").collect()
    return sorted((r.seq, r.rule_id.split(".", 1)[1], r.matched_fields) for r in rows)


CASES = [
    (event(1, 1, name="PowerShell.exe", cmd="x"), "t1059_001.powershell_process_start", ["process.name", "process.executable"]),
    (event(2, 1, name="cmd.exe", cmd="cmd /c POWERSHELL.exe"), "t1059_001.powershell_process_start", ["process.command_line"]),
    (download_process(3), "t1105.lolbin_download", ["process.command_line"]),
    (download_network(4, data=None), "t1105.lolbin_download", ["destination.ip"]),
    (download_network(5, data={"N": "edr_demo_t1105"}), "t1105.lolbin_download", ["destination.ip", "sysmon.event_data"]),
    (download_file(6), "t1105.lolbin_download", ["file.path", "file.name"]),
    (run_key_write(7), "t1547_001.registry_run_key_persistence", ["registry.path", "registry.value", "registry.data.strings"]),
    (proxy_process(8), "t1218.lolbin_suspicious_execution", ["process.name", "process.command_line"]),
]
BENIGN = [
    event(20, 1, name="cmd.exe", cmd="whoami"),
    download_network(21, data={"N": "other"}),
    download_network(22, destination={"ip": "8.8.8.8", "domain": "a.b"}),
    event(23, 11, name="certutil.exe", file={"path": r"C:\tmp\edr_demo.txt", "name": "edr_demo.txt"}),
    run_key_write(24, registry={"path": r"HKLM\Other", "value": "v", "data": {"strings": ["cmd.exe"]}}),
    run_key_process(25),
]


@pytest.mark.parametrize("rules", [R.NATIVE_RULES, R.SIGMA_LIKE_RULES])
def test_rules_fire_with_their_fields(spark, rules):
    expected = sorted((d["winlog"]["record_id"], rule, f) for d, rule, f in CASES)
    assert fired(spark, [d for d, _, _ in CASES] + BENIGN, rules) == expected


def test_text_codes_fail_the_typed_gate(spark):
    df = events_df(spark, [CASES[0][0]]).withColumn("code_is_string", F.lit(True))
    assert R.evaluate(df, R.NATIVE_RULES).count() == 0


def test_missing_values_in_the_gates(spark):
    doc = event(1, 1, name="powershell.exe", cmd="x")
    doc["event"].pop("code")
    doc["event"].pop("dataset")
    spec = {
        "id": "r", "title": "t", "level": "low", "confidence": "low", "description": "d",
        "detection": {"selection": {"process.name|equals": ["PowerShell.exe"], "user.name": "ignored"}, "condition": "selection"},
        "attack": {"technique_id": "T", "technique_name": "n", "tactic": ["x"]},
    }
    sigma = R.rule_from_dict(spec, "sigma-like")
    assert R.evaluate(events_df(spark, [doc]), [sigma]).count() == 1
    native = R.rule_from_dict(
        {
            "id": "n", "name": "n", "version": 1, "severity": "low", "confidence": "low",
            "attack": spec["attack"], "data_source": {"event_dataset": "d", "event_code": 1},
            "match": {"any": [{"field": "process.name", "equals_any": ["powershell.exe"]}]},
        }
    )
    assert R.evaluate(events_df(spark, [doc]), [native]).count() == 0


def test_catalogue_checks(spark):
    good = R.rules_df(spark, R.union_rules(R.NATIVE_RULES, R.SIGMA_LIKE_RULES))
    assert R.rule_violations(good).count() == 0
    bad = good.limit(1).withColumn("severity", F.lit("huge")).withColumn("tactic", F.array().cast("array<string>"))
    found = {r.violation for r in R.rule_violations(bad.unionByName(bad)).collect()}
    assert found == {"bad:severity", "bad:tactic", "duplicate:rule_id"}


def test_alert_documents(spark):
    df = events_df(spark, [CASES[0][0], CASES[6][0]])
    alerts = A.run_engines(df, "all", "2026-01-01T00:00:00Z")
    rows = alerts.collect()
    assert len(rows) == 4 and len({r.alert.id for r in rows}) == 4
    assert {A_.alert.id for A_ in A.run_engines(df, "all", "x").collect()} == {r.alert.id for r in rows}
    native = [r for r in rows if r.detection.engine is None]
    assert len(native) == 2 and all(r.alert.kind == "signal" and r.alert.status == "open" for r in rows)
    run_key = next(r for r in native if r.rule.id.startswith("det.t1547"))
    assert run_key.alert.severity == "high" and run_key.registry.value == "EDRDemo" and run_key.file is None
    moved = A.with_source(df, F.lit("i"), F.col("seq").cast("string"))
    assert {r.alert.id for r in A.run_engines(moved, "all", "x").collect()}.isdisjoint({r.alert.id for r in rows})
    with pytest.raises(ValueError):
        A.run_engines(df, "other")


def test_plan_is_one_scan_without_shuffle(spark, tmp_path):
    path = str(tmp_path / "events")
    events_df(spark, [d for d, _, _ in CASES]).write.parquet(path)
    alerts = A.run_engines(spark.read.parquet(path), "all", "x").select("rule.id", "host.name")
    plan = alerts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "hashpartitioning" not in plan and "Python" not in plan
    assert "working_directory" not in plan.split("ReadSchema")[1]


def test_realtime_rules(spark):
    docs = [
        event(1, 1, name="pwsh.exe", cmd="pwsh -NoProfile"),
        event(2, 1, name="cmd.exe", cmd="cmd EDR_DEMO_TP_3"),
        event(3, 3, name="curl.exe", destination={"ip": "127.0.0.1", "domain": "localhost"}),
        event(4, 13, name="reg.exe", registry={"path": r"HKCU\X\CurrentVersion\RunOnce", "value": "RunOnce"}),
        event(5, 1, name="rundll32.exe", cmd="rundll32 url.dll,FileProtocolHandler"),
        event(6, 1, name="notepad.exe", cmd="notepad"),
        event(7, 1, name="pwsh.exe", cmd="pwsh EDR_DEMO_TP_1 -nop"),
    ]
    alerts = RT.realtime_alerts(events_df(spark, docs))
    rows = alerts.select(F.col("winlog.record_id") if "winlog" in alerts.columns else F.col("source_id").alias("s"), "rule.id", "detection.matched_fields").collect()
    got = sorted((int(r.s), r.id.split(".")[2], r.matched_fields) for r in rows)
    assert got == [
        (1, "t1059_001", ["process.name", "process.command_line"]),
        (2, "t1547_001", ["process.command_line"]),
        (3, "t1105", ["destination.ip", "destination.domain"]),
        (4, "t1547_001", ["registry.path", "registry.value"]),
        (5, "t1218_lite", ["process.name", "process.command_line"]),
        (7, "t1059_001", ["process.command_line"]),
        (7, "t1059_001", ["process.name", "process.command_line"]),
    ]
    assert RT.distinct_alerts(alerts).count() == 6


def test_candidates(spark):
    docs = [event(n, 1, ts=f"2026-05-01T10:00:{n:02d}Z", name="x.exe", cmd="run PowerShell.EXE") for n in range(1, 6)]
    rows = R.candidates(events_df(spark, docs + BENIGN), 3).collect()
    assert [r.seq for r in rows] == [5, 4, 3]
