"""Case matrix goldens, classification, coverage and dashboard roll-ups."""

from __future__ import annotations

from helpers import (
    download_file, download_network, download_process, event, events_df, proxy_process, run_key_process, run_key_write,
)
from pyspark.sql import functions as F

from huntframe import catalog
from huntframe.operators import coverage as C
from huntframe.operators import dashboard as D
from huntframe.operators import dedupe as U
from huntframe.operators import evaluate as V
from huntframe.operators import sequences as Q
from huntframe.plans import pipelines

T = "2026-05-01T10:{:02d}:00Z"


def shell(seq, **kw):
    return event(seq, 1, **{"name": "powershell.exe", "cmd": "powershell.exe Get-Process", **kw})


def odd(seq, **kw):
    kw = {"name": "update.exe", "cmd": "update.exe -enc AAA webclient", "parent": "p", "parent_name": "winword.exe", **kw}
    doc = event(seq, 1, **kw)
    doc["process"]["executable"] = "D:\\update.exe"
    return doc


def calm(seq, **kw):
    return event(seq, 1, **{"name": "cmd.exe", "cmd": "cmd.exe /c dir", "parent": "p", "parent_name": "explorer.exe", **kw})


# (case, engine, technique, expected alert, expected response, protection, events)
CASES = [
    *[(f"shell_{n}", "all", "T1059.001", True, True, "dry-run", [shell]) for n in (1, 2, 3)],
    *[(f"odd_{n}", "ml-anomaly", "T1059.001", True, False, "none", [odd]) for n in (1, 2)],
    ("calm_all", "all", None, False, False, "none", [calm]),
    ("calm_ml_1", "ml-anomaly", None, False, False, "none", [calm]),
    ("admin_shell", "all", "T1059.001", False, False, "none", [shell]),
    ("missed", "all", "T1059", True, False, "none", [lambda s, **k: event(s, 1, name="wscript.exe", cmd="wscript x", **k)]),
    ("calm_ml_2", "ml-anomaly", None, False, False, "none", [calm]),
    ("dl_process", "all", "T1105", True, False, "none", [download_process]),
    ("dl_network", "all", "T1105", True, False, "none", [lambda s, **k: download_network(s, data=None, **k)]),
    ("dl_file", "all", "T1105", True, False, "none", [download_file]),
    ("run_key", "all", "T1547.001", True, False, "none", [run_key_write]),
    ("proxy", "all", "T1218", True, False, "none", [proxy_process]),
    ("seq_dl", "behavioral", "T1105", True, False, "none", [download_process, download_network, download_file]),
    ("seq_key", "behavioral", "T1547.001", True, False, "none", [run_key_process, run_key_write]),
    ("seq_none", "behavioral", None, False, False, "none", [calm, lambda s, **k: download_network(s, **{**k, "entity": "z"})]),
    ("calm_net", "all", None, False, False, "none", [lambda s, **k: download_network(s, destination={"ip": "9.9.9.9"}, **k)]),
    ("calm_file", "all", None, False, False, "none", [lambda s, **k: event(s, 11, name="a.exe", file={"path": "C:\\a", "name": "a"}, **k)]),
]


def matrix(spark):
    docs, seq = [], 0
    for case_id, *_, makers in CASES:
        for n, make in enumerate(makers):
            seq += 1
            docs.append({**make(seq, ts=T.format(n), entity="e"), "case_id": case_id})
    cases = spark.createDataFrame(
        [c[:6] for c in CASES],
        "case_id string, engine string, technique_id string, expected_alert boolean, expected_response boolean, expected_protection string",
    )
    events = events_df(spark, docs, "case_id string")
    return pipelines.run_case_matrix(cases, events).cache()


def counts(df, metric):
    return {r.key: r.n for r in df.collect() if r.metric == metric}


def test_case_matrix_and_dashboard(spark):
    rows = matrix(spark)
    c = V.classification_counts(rows).first()
    assert tuple(c) == (12, 6, 1, 1)
    by_id = {r.case_id: r for r in rows.collect()}
    assert by_id["shell_1"].actual_engines == ["native", "sigma-like"] and by_id["shell_1"].response_count == 2
    assert by_id["seq_dl"].event_code == "1/3/11" and by_id["seq_dl"].correlated_sequence_count == 1
    assert by_id["odd_1"].actual_rule_ids == ["ml.process_anomaly"]
    d = V.dashboard_counts(rows).cache()
    assert counts(d, "alert_count_by_engine") == {"behavioral": 2, "ml-anomaly": 2, "native": 9, "sigma-like": 9}
    assert counts(d, "alert_count_by_technique") == {"T1059.001": 10, "T1105": 7, "T1218": 2, "T1547.001": 3}
    assert counts(d, "protection_count") == {"dry-run": 3, "none": 17}
    assert counts(d, "total")["correlated_sequence_count"] == 2

    sequences = d.where("metric = 'sequence_count_by_name'").select(F.col("key").alias("sequence_name"), "n")
    agg = C.aggregate_techniques(
        C.covered_techniques(spark), C.rule_inventory(spark), rows.withColumn("indexed_response_count", F.lit(0)), sequences
    )
    scores = {r.technique_id: (r.score, r.demo_case_count, r.sequence_count) for r in agg.collect()}
    # The shell technique also has anomaly evidence here; no behavioural engine covers it.
    assert scores == {"T1059.001": (4, 6, 0), "T1105": (4, 4, 1), "T1547.001": (4, 2, 1), "T1218": (4, 1, 0)}
    layer = {r.technique_id: r for r in C.navigator_rows(agg).orderBy("rank").collect()}
    assert list(layer) == ["T1059.001", "T1105", "T1547.001", "T1218"]
    assert "ML anomaly" in layer["T1059.001"].comment and layer["T1105"].tactic == "command-and-control"
    assert layer["T1105"].notes[-1] == "Dashboard sequence count: 1."

    view = {r.case_id: r for r in D.case_view(rows.select("case_id", "technique_id", "classification", "alert_count", "actual_rule_ids", "event_code", "expected_alert"), rows.select("case_id", "engine"), C.rule_inventory(spark)).collect()}
    assert view["run_key"].severity == "high" and view["calm_all"].severity == "unknown" and view["calm_all"].technique_id == "-"


def test_failures_selection_and_unknown_ids(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "case_id string")
    failed = V.with_failures(rows, spark.createDataFrame([("b", "boom")], "case_id string, error string"))
    assert {r.case_id: r.status for r in failed.collect()} == {"a": "passed", "b": "failed"}
    assert [r.case_id for r in V.select_cases(failed, None, include_failures=False).collect()] == ["a"]
    assert [r.case_id for r in V.select_cases(failed, ["b"]).collect()] == ["b"]
    wanted = spark.createDataFrame([("a",), ("x",)], "case_id string")
    assert [r.case_id for r in V.unknown_case_ids(rows, wanted).collect()] == ["x"]
    verdict = spark.createDataFrame([(True,), (None,)], "passed boolean")
    assert V.all_passed(verdict).first().all_passed is False and V.all_passed(verdict.limit(0)).first().all_passed is True


def test_case_catalogue_checks(spark):
    ok = ("a", "attack", "xml", "all", "none", "phase8", True, ["native"], ["r"])
    bad = ("a", "other", "xml", "all", "execute-lab-only", "phase8", False, [], [])
    df = spark.createDataFrame(
        [ok, bad],
        "case_id string, category string, input_type string, engine string, expected_protection string, runner_mode string, "
        "expected_alert boolean, expected_engines array<string>, expected_rule_ids array<string>",
    )
    found = {r.violation for r in V.case_violations(df).collect()}
    assert found == {"bad:category", "unsupported:execute-lab-only", "duplicate:case_id"}


def test_totals_capabilities_and_scope(spark):
    cases = spark.createDataFrame([("true_positive",), ("true_negative",)], "classification string")
    stored = spark.createDataFrame([(9, 0, 0, 0, 4)], "total_cases int, true_positive_count int, true_negative_count int, false_positive_count int, false_negative_count int")
    assert tuple(C.case_matrix_totals(cases, stored).first()) == (9, 1, 1, 0, 4)
    assert tuple(C.case_matrix_totals(cases).first()) == (2, 1, 1, 0, 0)
    caps = spark.createDataFrame([("t", []), ("k", ["a", "b"]), ("n", ["a"]), ("m", ["zz"])], "capability string, validation_ids array<string>")
    runs = spark.createDataFrame([("a", "passed", 3), ("b", "failed", None)], "id string, status string, response_count int")
    assert {r.capability: r.status for r in C.capability_status(caps, runs).collect()} == {"t": "passed", "k": "failed", "n": "passed", "m": "failed"}
    protection = spark.createDataFrame([("dry-run", 3), ("none", 17)], "key string, n int")
    known = spark.createDataFrame([("soar_dry_run",)], "capability string")
    limits = spark.createDataFrame([("It does not execute production containment.",)], "text string")
    scope = D.response_scope(protection, known, runs, limits).first()
    assert (scope.soar_mode, scope.protection_evidence, scope.containment_mode) == ("dry-run", "3 dry-run cases / 17 none", "not implemented")
    assert scope.soar_evidence == "planned response only" and scope.protection_mode == "not shown"


def test_inventory(spark):
    inventory = C.rule_inventory(spark)
    assert tuple(C.engine_summary(inventory).first()) == (4, 4, 3, 11)
    assert C.technique_cross_check(C.covered_techniques(spark), inventory).count() == 0
    ordered = C.order_preferred(spark.createDataFrame([("z",), ("b",), ("a",)], "k string"), "k", ("b",))
    assert [r.k for r in ordered.collect()] == ["b", "a", "z"]


def test_dashboard_lookups(spark):
    states = spark.createDataFrame(
        [(1, "c1", "complete", "true_positive", True), (2, "c2", "pending", "", False)],
        "case_ord int, case_id string, status string, classification string, expected_alert boolean",
    )
    links = spark.createDataFrame([("c1", "rule", "r1"), ("c2", "alert", "a9"), ("c2", "event", "a1")], "case_id string, kind string, id string")
    alerts = spark.createDataFrame(
        [("a9", "r1"), ("a9", "rX"), ("a1", "rX")], "alert_id string, rule_id string"
    ).selectExpr("*", "'T' technique_id", "'e' engine", "'' severity", "cast(null as string) process_name", "1 event_code", "'t' timestamp")
    rows = {(r.alert_id, r.rule_id): r for r in D.alert_table(alerts, states, links).collect()}
    assert rows["a9", "r1"].classification == "true_positive" and rows["a9", "rX"].classification == "pending"
    assert rows["a1", "rX"].classification == "pending" and rows["a1", "rX"].expected_alert is True
    assert rows["a1", "rX"].severity == "unknown" and rows["a1", "rX"].process == "-"


def test_episodes_follow_the_clock(spark):
    cases = (
        catalog.EvaluationCase("tp", "MARK_TP", "T", True, 8, ("r1",)),
        catalog.EvaluationCase("tn", "MARK_TN", "T", False, 6),
        catalog.EvaluationCase("fp", "MARK_FP", "T", False, 6),
    )
    at = "timestamp'2026-05-01 10:00:{:02d}'"
    def docs(rows, extra=""):
        df = spark.createDataFrame(rows, f"text string, sec int, event_id string{extra}")
        return df.withColumn("ts", F.expr("timestamp'2026-05-01 10:00:00' + make_interval(0,0,0,0,0,0,sec)"))
    seen = V.matching_cases(docs([("x mark_tp", 0, "1"), ("mark_tn", 1, "2"), ("mark_tn", 20, "3"), ("mark_fp", 2, "4")]), F.col("text"), cases)
    fired = V.matching_cases(
        docs([("mark_tp", 0, "1", "other"), ("mark_fp", 2, "4", "rz")], ", rule_id string").withColumn("alert_id", F.concat(F.lit("a"), "event_id")),
        F.col("text"), cases,
    )
    run = lambda sec: {(r.case_id, r.episode): r.classification or r.status for r in V.evaluate_episodes(seen, fired, F.expr(at.format(sec))).collect()}
    assert run(3) == {("tp", 1): "pending", ("tn", 1): "pending", ("tn", 2): "pending", ("fp", 1): "false_positive"}
    # The alert's rule was not the expected one, so the expected marker ends as a miss.
    assert run(22) == {("tp", 1): "false_negative", ("tn", 1): "true_negative", ("tn", 2): "pending", ("fp", 1): "false_positive"}
    links = V.episode_links(V.activity(seen, fired))
    assert sorted(tuple(r) for r in links.collect()) == [
        ("fp", 1, "alert", "a4"), ("fp", 1, "event", "4"), ("fp", 1, "rule", "rz"), ("tn", 1, "event", "2"), ("tn", 2, "event", "3"),
        ("tp", 1, "alert", "a1"), ("tp", 1, "event", "1"), ("tp", 1, "rule", "other"),
    ]
    assert sorted((r.case_id, r.episode, r.id) for r in V.last_links(links).where("kind = 'event'").collect()) == [("fp", 1, "4"), ("tn", 2, "3"), ("tp", 1, "1")]
    lost = V.untimed(V.activity(seen.withColumn("ts", F.lit(None).cast("timestamp")), fired))
    assert {(r.case_id, r.kind, r.id, r.reason) for r in lost.collect()} >= {("tn", "event", "2", "missing_time"), ("fp", "event", "4", "missing_time")}
    counts_row = V.state_counts(V.latest_states(V.evaluate_episodes(seen, fired, F.expr(at.format(59))), V.case_table(spark, cases).drop("expected_rule_ids", "window_seconds"))).first()
    assert (counts_row.case_count, counts_row.true_negative, counts_row.false_negative, counts_row.not_seen) == (3, 1, 1, 0)


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, "c")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in U.first_by(df, "k", F.col("o")).collect()) == [(1, "a"), (2, "c")]
    assert [r.k for r in U.only_new(df, df.where("k = 1"), "k").collect()] == [2]


def test_required_rules(spark):
    required = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r3"), ("c", "r4")], "name string, rule_id string")
    actual = spark.createDataFrame([("a", "r1", 3), ("a", "r9", 2), ("b", "r3", 1)], "name string, rule_id string, n bigint")
    rows = V.containment_checks(required, actual)
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 2, 1, 5, False), ("b", 1, 0, 1, True), ("c", 1, 1, 0, False)]
    report = C.coverage_report(spark, rows, "now").first()
    assert (report.all_passed, len(report.rule_inventory), len(report.covered_techniques), len(report.validation_results)) == (False, 11, 4, 3)
    assert C.coverage_report(spark, rows.where("passed"), "now").first().all_passed
    assert C.coverage_report(spark, rows.limit(0), "now").first().all_passed


def test_case_failures_are_dead_letters_of_the_plan(spark):
    docs = [{**calm(1, ts=T.format(1)), "case_id": "good"}, {**download_network(2, ts=T.format(2)), "case_id": "bad"}, {**shell(3, ts=T.format(3)), "case_id": "bad"}]
    cases = spark.createDataFrame(
        [("good", "ml-anomaly", False), ("bad", "ml-anomaly", True), ("none", "behavioral", True)], "case_id string, engine string, expected_alert boolean"
    )
    rows = {r.case_id: r for r in pipelines.run_case_matrix(cases, events_df(spark, docs, "case_id string")).collect()}
    assert (rows["good"].status, rows["good"].normalized_event_count, rows["good"].classification) == ("passed", 1, "true_negative")
    assert (rows["bad"].status, rows["bad"].error, rows["bad"].alert_count, rows["bad"].normalized_event_count) == ("failed", "wrong_event_code", 0, 0)
    assert rows["bad"].classification == "false_negative" and rows["none"].status == "passed" and rows["none"].event_code is None


def test_running_numbers(spark):
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("_range_name"))
    got = Q.running_numbers(df, ("k",)).collect()
    assert sorted((r.k, r.number) for r in got) == [(i, i + 1) for i in range(5000)]
    assert Q.running_numbers(df.limit(0), ("k",)).count() == 0
