"""Sources, sinks and streaming operators on files."""

from __future__ import annotations

import json

import pytest
from helpers import download_file, download_network, download_process, event, events_df, run_key_write
from pyspark.sql import functions as F

from huntframe import catalog, schemas
from huntframe.operators import alerts as A
from huntframe.operators import dashboard as D
from huntframe.operators import envelope as E
from huntframe.operators import evaluate as V
from huntframe.operators import realtime as RT
from huntframe.operators import rules as R
from huntframe.sources import readers, sinks
from huntframe.sources import telemetry_view as TV
from huntframe.streaming import correlator as SC
from huntframe.streaming import live
from huntframe.streaming import evaluation as SE
from huntframe.streaming import pipelines as SP

T = "2026-05-01T10:{:02d}:00Z"


def test_event_documents(spark, tmp_path):
    one = event(1, 1, name="powershell.exe", cmd="x")
    one["event"]["code"] = "1"
    two = run_key_write(2)
    two["registry"]["data"]["strings"] = "powershell.exe bare"
    (tmp_path / "one.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "many.json").write_text(json.dumps([two, event(3, 3)], indent=1))
    rows = {r.winlog.record_id: r for r in readers.read_events_json(spark, str(tmp_path)).collect()}
    assert rows[1].code_is_string and rows[1].event.code == 1 and not rows[2].code_is_string
    assert rows[2].registry.data.strings == ["powershell.exe bare"] and len(rows) == 3
    df = readers.read_events_json(spark, str(tmp_path))
    assert [r.rule_id for r in R.evaluate(df, R.NATIVE_RULES).collect()] == ["det.t1547_001.registry_run_key_persistence"]


def test_xml_files_search_hits_and_log_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Event>\n</Event>")
    assert readers.read_xml_documents(spark, str(tmp_path)).first().xml == "<Event>\n</Event>"
    response = json.dumps({"hits": {"hits": [{"_index": "i", "_id": "d", "_source": event(1, 1, name="a.exe")}, {"_id": "x"}]}})
    (hit,) = readers.parse_search_hits(spark.createDataFrame([(response,)], "value string")).collect()
    assert (hit.src_doc["index"], hit.src_doc.document_id, hit.process.name) == ("i", "d", "a.exe")
    texts = ['{"RecordId": 7, "Id": 3, "TimeCreated": "2026-05-01T10:00:00Z"}', '[{"RecordId": 8, "Id": 99}, {"Id": "1"}]', ""]
    records = readers.decode_log_rows(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted((r.record_id, r.event_id) for r in records.collect()) == [(0, 1), (7, 3), (8, 99)]
    assert [r.record_id for r in readers.filter_log_rows(records, "2026-05-01T09:00:00Z").collect()] == [7]


def test_optional_input(spark, tmp_path):
    assert readers.read_optional(spark, None, schemas.USER).count() == 0
    assert readers.read_optional(spark, str(tmp_path / "none.json"), schemas.USER).count() == 0


def test_daily_upserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "alerts")
    df = events_df(spark, [event(n, 1, name="powershell.exe", cmd=f"powershell.exe {n}") for n in range(4)])
    alerts = A.detect(df, R.NATIVE_RULES[:1], "x")
    day = F.lit("2026-05-01").cast("date")
    sinks.write_alerts(alerts, path, day)
    other = F.lit("2026-05-02").cast("date")
    sinks.write_alerts(alerts, path, other)
    changed = alerts.withColumn("alert", F.col("alert").withField("status", F.lit("closed")))
    sinks.write_alerts(changed, path, day)
    rows = spark.read.parquet(path).groupBy("index_date", "alert.status").count().collect()
    assert sorted((str(r.index_date), r.status, r["count"]) for r in rows) == [("2026-05-01", "closed", 4), ("2026-05-02", "open", 4)]
    assert readers.read_event_table(spark, path, "2026-05-02").count() == 4
    assert readers.read_alerts(spark, path, 3).count() == 3


def stream_of(spark, tmp_path, df, name="in", files=1):
    path = str(tmp_path / name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


def test_consume_and_detect_and_message_sinks(spark, tmp_path):
    topic = str(tmp_path / "topic")
    df = events_df(spark, [event(1, 1, name="powershell.exe", entity="e", cmd="powershell.exe a")])
    sinks.write_message_files(E.serialize(E.build_envelopes(df, "fixture", "t")), topic)
    out = SP.drain(SP.consume_and_detect(readers.envelope_directory(spark, topic)), "consume")
    assert sorted(r.rule.id for r in out.collect()) == ["det.t1059_001.powershell_process_start", "sigma_like.t1059_001.powershell_process_start"]
    spark.createDataFrame([("broken",)], "value string").write.mode("append").text(topic)
    lenient = SP.consume_and_detect(readers.envelope_directory(spark, topic), fail_fast=False)
    assert SP.drain(lenient, "lenient").count() == 2
    lines = str(tmp_path / "lines")
    sinks.stream_json_lines(readers.envelope_directory(spark, topic), lines, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(lines).count() == 2


def test_stream_upserts_and_snapshots(spark, tmp_path):
    df = events_df(spark, [event(n, 1, name="a.exe", cmd=str(n)) for n in range(3)]).withColumn("day", F.lit("2026-05-01").cast("date"))
    stream = stream_of(spark, tmp_path, df.unionByName(df), files=2)
    path = str(tmp_path / "daily")
    sinks.stream_upserts(stream, path, F.col("seq").cast("string"), F.col("day"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 3
    sinks.write_snapshots({"events": df, "alerts": df.limit(1)}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap" / "events")).count() == 3
    raw = df.select("seq", F.col("day").alias("index_date"))
    sinks.stream_daily_raw(stream_of(spark, tmp_path, raw, "raw"), str(tmp_path / "rawout"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rawout")).count() == 3


def test_stream_dedupe(spark, tmp_path):
    df = spark.sql("SELECT id % 3 AS record_id, timestamp'2026-05-01 10:00:00' AS ts FROM range(9)")
    out = SP.drain(SP.distinct_records(stream_of(spark, tmp_path, df, files=1)), "distinct")
    assert sorted(r.record_id for r in out.collect()) == [0, 1, 2]


def correlator_docs():
    return [
        download_process(1, ts=T.format(0), entity="a"),
        download_network(2, ts=T.format(1), entity="a"),
        download_file(3, ts=T.format(2), entity="a", host="H2"),
        # Evicts the first process; the second then completes a new triple.
        download_process(4, ts=T.format(3), entity="a"),
        event(5, 1, ts=T.format(5), name="notepad.exe", entity="a", cmd="n"),
        event(6, 1, ts="2026-05-01T10:05:30Z", name="notepad.exe", entity="a", cmd="n"),
    ]


def triples(df):
    return sorted((r.process_id, r.network_id, r.file_id) for r in df.collect())


def test_correlator_batch_and_stream(spark, tmp_path):
    df = events_df(spark, correlator_docs())
    expected = [("1", "2", "3"), ("4", "2", "3")]
    assert triples(RT.correlate(df)) == expected
    assert triples(RT.correlate(df, host_scoped=True)) == []
    assert triples(SC.drain_correlation(stream_of(spark, tmp_path, df))) == expected


def queue_triples(docs, window=300):
    """The correlator as a queue per key, fed in time order."""
    from collections import defaultdict

    queues, out = defaultdict(list), set()
    for seq, step, key, sec in sorted(docs, key=lambda d: (d[3], d[0])):
        if step in "pnf":
            queues[key].append((seq, step, sec))
        queues[key] = [e for e in queues[key] if e[2] >= sec - window]
        first = {}
        for e in queues[key]:
            first.setdefault(e[1], str(e[0]))
        if {"p", "n", "f"} <= first.keys():
            out.add((first["p"], first["n"], first["f"]))
    return sorted(out)


def plain_doc(seq, step, key, sec):
    stamp = f"2026-05-01T{10 + sec // 3600:02}:{sec // 60 % 60:02}:{sec % 60:02}Z"
    name = f"{key}.exe" if step == "x" else "certutil.exe"
    make = {"p": download_process, "n": download_network, "f": download_file}.get(step, event)
    return make(seq, ts=stamp, entity=key, name=name, **({"cmd": "quiet"} if step == "x" else {}))


def test_correlator_over_many_micro_batches(spark, tmp_path):
    """Random arrivals of a few keys, one file per stretch of time, against the queue and the batch form."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice("pnfxxx"), rng.choice("ab"), rng.randrange(4000)) for i in range(120)]
    # the correlator's other keys (image, markers) join the entities here; the query's check SQL covers them in full
    docs = [{**plain_doc(*r), "part": n // 40} for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))]
    whole = events_df(spark, docs, "part int")
    df, path = whole.drop("part"), tmp_path / "arrivals"
    for n in range(3):
        whole.where(F.col("part") == n).drop("part").coalesce(1).write.parquet(str(path / f"part-{n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = triples(SC.drain_correlation(stream))
    assert got == triples(RT.correlate(df)) and len(got) > 5


def test_hot_key_in_one_window(spark):
    """100,000 arrivals of one key within one window: no task gets more than a small share, and no pair forms."""
    rows = spark.range(100_000).select(
        F.lit("entity:a").alias("key"), F.col("id").cast("string").alias("eid"), F.col("id").cast("string").alias("stamp"), F.col("id").alias("o"),
        F.when(F.col("id") % 100 < 3, F.element_at(F.array(*map(F.lit, RT.STEPS)), (F.col("id") % 100 + 1).cast("int"))).alias("step"),
        (F.col("id") * 2900).alias("t"),
    )
    got = triples(RT.correlated_trios(rows, rows.where("step IS NOT NULL"), 300))
    # nothing leaves the window, so the first events of each step stay
    assert got == [("0", "1", "2")]
    short = triples(RT.correlated_trios(rows, rows.where("step IS NOT NULL"), 3))
    docs = [(i, {0: "p", 1: "n", 2: "f"}.get(i % 100, "x"), "a", i * 0.0029) for i in range(100_000)]
    assert short == queue_triples(docs, 3)


def in_files(spark, path, df, order):
    """A stream that gets one file per micro-batch: the rows whose number modulo the files is next in ``order``."""
    for place, n in enumerate(order):
        df.where(F.pmod("seq", F.lit(len(order))) == n).coalesce(1).write.parquet(str(path / f"part-{place}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_live_view_over_several_files(spark, tmp_path):
    """Summary, newest rows and alert log of a stream of several files against the batch forms."""
    docs = correlator_docs() + [event(s, 1, ts=T.format(s % 9), name="powershell.exe", cmd="powershell.exe -NoProfile x") for s in range(24, 32)]
    df = events_df(spark, docs).withColumn("ts", F.to_timestamp("`@timestamp`"))
    df = df.unionByName(df.where("seq = 31").withColumns({"seq": F.lit(99).cast("bigint"), "ts": F.lit(None).cast("timestamp"), "@timestamp": F.lit("x")}))
    stream = in_files(spark, tmp_path / "in", df, (0, 1))
    base = str(tmp_path)
    summary, newest = live.LiveSummary(base), live.latest_events(base, 5)
    log = live.AlertLog(base, SC.Correlator(f"{base}/correlator"), 86_400)
    live.run_jobs(stream, f"{base}/checkpoint", summary, newest, log).awaitTermination()
    events = df.select(F.col("event.code").cast("string").alias("event_code"), RT.timestamp().alias("timestamp"))
    alerts = RT.realtime_alerts(df)
    flat = alerts.select(F.col("attack.technique.id").alias("technique_id"), F.col("detection.engine").alias("engine"), "severity", "timestamp")
    assert {tuple(r) for r in summary.rows(spark).collect()} == {tuple(r) for r in D.summary(events, flat).collect()}
    wanted = [r.seq for r in df.orderBy(F.desc_nulls_last("ts"), F.desc("seq")).limit(5).collect()]
    assert [r.seq for r in newest.rows(spark).collect()] == wanted and [r.seq for r in newest.rows(spark, 2).collect()] == wanted[:2]
    logged = log.alerts(spark).collect()
    ids = [r.alert_id for r in logged]
    assert len(ids) == len(set(ids))
    assert {r.alert_id for r in logged if r.engine != "behavioral"} == {r.id for r in RT.distinct_alerts(alerts).select("alert.id").collect()}
    # the last micro-batch again, as after a failure, leaves everything as it is
    before = [sorted(map(repr, x.collect())) for x in (summary.rows(spark), newest.rows(spark), log.alerts(spark))]
    for job in (summary, newest, log):
        job(df.where(F.pmod("seq", F.lit(2)) == 1), 1)
    assert before == [sorted(map(repr, x.collect())) for x in (summary.rows(spark), newest.rows(spark), log.alerts(spark))]


def test_shuffled_files_give_the_batch_result(spark, tmp_path):
    df = events_df(spark, correlator_docs()).withColumn("ts", F.to_timestamp("`@timestamp`"))
    stream = in_files(spark, tmp_path / "in", df, (2, 0, 1))
    correlator = SC.Correlator(str(tmp_path / "correlator"))
    ordered = live.OrderedRelease(str(tmp_path / "order"), stream.schema, correlator, 3600, record_id="seq")
    live.run_jobs(stream, str(tmp_path / "checkpoint"), ordered).awaitTermination()
    ordered.finish(spark)
    assert triples(correlator.alerts(spark)) == triples(RT.correlate(df))


def test_correlated_documents(spark):
    df = events_df(spark, correlator_docs())
    docs = {tuple(d.source_event_ids): d for d in RT.correlated_alert_documents(RT.correlate(df), df.unionByName(df)).collect()}
    d = docs["1", "2", "3"]
    assert [e.event.code for e in d.related_events] == ["1", "3", "11"] and d.source_event.id == "3" and d.host.name == "H2"
    assert d.detection.sequence_steps == ["process", "network", "file"] and "file.path" in d.evidence and d.alert.severity == "high"
    gone = RT.correlated_alert_documents(RT.correlate(df), df.where("seq <> 2")).collect()
    assert sorted(len(g.related_events) for g in gone) == [2, 2]


def test_evaluation_stream_with_timers(spark, tmp_path):
    cases = (
        catalog.EvaluationCase("tp", "MARK_TP", "T", True, 8),
        catalog.EvaluationCase("tn", "MARK_TN", "T", False, 6),
        catalog.EvaluationCase("clock", "MARK_CLOCK", "T", False, 6),
    )
    rows = [("mark_tp", 0, None), ("mark_tn", 1, None), ("mark_tp", 2, "r1"), ("mark_clock", 60, None)]
    df = spark.createDataFrame(rows, "text string, sec int, rule_id string").withColumn(
        "ts", F.expr("timestamp'2026-05-01 10:00:00' + make_interval(0,0,0,0,0,0,sec)")
    )
    path = str(tmp_path / "marks")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    matched = V.matching_cases(stream, F.col("text"), cases).withColumns({c: F.concat_ws("-", F.lit(c), "text", "sec") for c in ("event_id", "alert_id")})
    parts = matched.where("rule_id IS NULL"), matched.where("rule_id IS NOT NULL")
    with SP.state_store(spark):
        emitted = SP.drain_batches(SE.track_cases(SE.evaluation_input(*parts), "1 second"), "track")
    out = SE.newest_states(emitted)
    found = SE.links(emitted, SP.drain(SE.link_ids(*parts), "ids"))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("clock", 1, "event", "event_id-mark_clock-60"), ("tn", 1, "event", "event_id-mark_tn-1"), ("tp", 1, "alert", "alert_id-mark_tp-2"),
        ("tp", 1, "event", "event_id-mark_tp-0"), ("tp", 1, "rule", "r1"),
    ]
    got = {r.case_id: (r.status, r.classification) for r in out.collect()}
    # The watermark passed the benign window, so its timer closed it without another event.
    assert got == {"tp": ("complete", "true_positive"), "tn": ("complete", "true_negative"), "clock": ("pending", "")}


def test_dashboard_series(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2026-05-01 10:10:00' AS ts, 1 AS event_code FROM range(4)")
    out = SP.drain_batches(SP.series(stream_of(spark, tmp_path, df)), "series")
    assert out.agg(F.max("n")).first()[0] == 4


def test_upserts_keep_rows_without_a_day(spark, tmp_path):
    path = str(tmp_path / "days")
    day = F.col("d").cast("date")
    put = lambda rows: sinks.upsert_daily(spark.createDataFrame(rows, "id string, d string, v int"), path, F.col("id"), day)
    nameless = str(tmp_path / "nameless")
    for _ in range(2):
        rows = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (None, "a", 2), ("x", "a", 3), ("x", "a", 4)], "id string, d string, v int")
        sinks.upsert_daily(rows, nameless, F.col("id"), F.lit("2026-05-01").cast("date"), F.col("v"))
    assert sorted(r.v for r in spark.read.parquet(nameless).collect()) == [1, 2, 4]
    with pytest.raises(ValueError, match="index_date"):
        sinks.upsert_daily(rows.withColumn("index_date", F.lit(1)), nameless, F.col("id"), F.lit(None).cast("date"))
    put([("n1", None, 1), ("a", "2026-05-01", 1), ("b", "2026-05-02", 1)])
    put([("n2", None, 2)])
    put([("a", "2026-05-01", 3)])
    rows = spark.read.parquet(path).collect()
    assert sorted((r.id, str(r.index_date), r.v) for r in rows) == [
        ("a", "2026-05-01", 3), ("b", "2026-05-02", 1), ("n1", "None", 1), ("n2", "None", 2)
    ]


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "part-0.parquet").write_text("not parquet")
    df = spark.createDataFrame([("a", "2026-05-01")], "id string, d string")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        sinks.upsert_daily(df, str(path), F.col("id"), F.col("d").cast("date"))


def test_streams_read_a_folder_of_parts(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    one, many = (SP.drain(TV.event_stream(spark, d).select("seq"), "parts").count() for d in (sf_dir, str(tmp_path)))
    assert one == many > 0


def test_upserts_of_very_many_days(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MAX_DAYS", 2)
    path, day = str(tmp_path / "daily"), F.col("d").cast("date")
    put = lambda rows: sinks.upsert_daily(spark.createDataFrame(rows, "id string, d string, v int"), path, F.col("id"), day)
    put([("a", "2024-01-01", 1), ("b", "2024-01-02", 1), ("c", None, 1), ("d", "2024-01-09", 1), ("e", "2024-01-01", 1)])
    put([("a", "2024-01-01", 2), ("b", "2024-01-02", 2), ("c", None, 2), ("f", "2024-01-03", 2)])
    got = {(r.id, r.d, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "2024-01-01", 2), ("b", "2024-01-02", 2), ("c", None, 2), ("d", "2024-01-09", 1), ("e", "2024-01-01", 1), ("f", "2024-01-03", 2)}


def test_a_replay_does_not_shuffle_documents(spark, tmp_path):
    path, day = str(tmp_path / "daily"), F.lit("2024-01-01").cast("date")
    docs = spark.range(100).select(F.col("id").cast("string").alias("name"), F.repeat(F.lit("x"), 50).alias("text"))
    sinks.upsert_daily(docs, path, F.col("name"), day)
    fresh = docs.select("*", F.col("name").alias("_doc_id"), day.alias("index_date"), F.struct(F.lit(1).alias("fresh"), F.lit(0).alias("rank")).alias("_new"))
    for stored in (None, spark.read.parquet(path)):
        merged = sinks.merged_days(fresh, stored)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Union" not in plan
        assert merged.count() == 100


@pytest.mark.parametrize("few", [100_000, 3, 0])
def test_upserts_against_brute_force(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(sinks, "FEW_IDS", few)
    path, day = str(tmp_path / "daily"), F.col("d").cast("date")
    days = ("2024-01-01", "2024-01-02", None)
    batches = [
        [(f"n{n}", days[n % 3], n, None) for n in range(20)],
        [(f"n{n}", days[0], 100 + n, "late") for n in (0, 1, 3, 6, 30)] + [("n0", days[0], 99, "lost"), ("n30", days[0], 500, "last")],
        [("n2", None, 7, None)],
        [(f"n{n}", days[n % 3], 200 + n, None) for n in range(20)],
    ]
    want = {}
    for rows in batches:
        put = {}
        for r in rows:
            put[r[:2]] = max(put.get(r[:2], r), r, key=lambda x: x[2])
        want |= put
        sinks.upsert_daily(spark.createDataFrame(rows, "id string, d string, v int, note string"), path, F.col("id"), day, F.col("v"))
        got = spark.read.parquet(path)
        assert got.columns == ["_doc_id", "id", "d", "v", "note", "index_date"]
        assert sorted(map(str, want.values())) == sorted(str((r.id, r.d, r.v, r.note)) for r in got.collect())
    assert [p.name for p in tmp_path.iterdir()] == ["daily"]


def test_stored_copies_of_an_id_count_once(spark, tmp_path):
    path, day = str(tmp_path / "daily"), F.lit("2024-01-01").cast("date")
    stored = spark.createDataFrame([("a", "a", 1), ("a", "a", 1), ("b", "b", 2)], "_doc_id string, id string, v int").withColumn("index_date", day)
    stored.write.partitionBy("index_date").parquet(path)
    sinks.upsert_daily(spark.createDataFrame([("b", 3)], "id string, v int"), path, F.col("id"), day)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
