"""Sequence matching against hand-written cases and an independent brute-force search."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from helpers import (
    download_file, download_network, download_process, event, events_df, proxy_process, run_key_process, run_key_write,
)
from pyspark.sql import functions as F

from huntframe.operators import following
from huntframe.operators import sequences as Q

T = "2026-05-01T10:{:02d}:00Z"


def found(spark, docs, window=None):
    m = Q.match_sequences(events_df(spark, docs), window_seconds=window)
    rows = m.select("def", "anchor", F.transform("matched", lambda x: x["eid"]).alias("ids")).collect()
    return sorted((r["def"], tuple(int(i) for i in r.ids)) for r in rows)


def trio(third=2, host="H1", **kw):
    return [
        download_process(1, ts=T.format(0), entity="a", pid=7),
        download_network(2, ts=T.format(1), **{"entity": "a", "pid": 7, **kw}),
        download_file(3, ts=T.format(third), host=host, entity="a", pid=7),
    ]


def test_process_network_file_chain(spark):
    assert found(spark, trio()) == [(0, (1, 2, 3))]


def test_input_order_does_not_matter(spark):
    assert found(spark, trio()[::-1]) == [(0, (1, 2, 3))]


def test_late_other_host_and_other_entity_do_not_match(spark):
    assert found(spark, trio(third=10)) == []
    assert found(spark, trio(host="H2")) == []
    assert found(spark, trio(entity="b")) == []


def test_window_override(spark):
    assert found(spark, trio(third=10), window=600) == [(0, (1, 2, 3))]


def test_pid_and_name_serve_without_entities(spark):
    docs = trio()
    for d in docs:
        d["process"]["entity_id"] = ""
    assert found(spark, docs) == [(0, (1, 2, 3))]


def test_optional_steps_and_used_events(spark):
    docs = [
        run_key_process(1, ts=T.format(0), entity="r"),
        run_key_write(2, ts=T.format(1), entity="r"),
        event(3, 1, ts=T.format(2), entity="x", parent="r", name="powershell.exe", cmd="powershell.exe EDRDemo"),
        proxy_process(4, ts=T.format(20), entity="p"),
    ]
    assert found(spark, docs) == [(1, (1, 2, 3)), (2, (4,))]


def test_alert_document(spark):
    alert = Q.behavioral_alerts(events_df(spark, trio())).first()
    assert alert.detection.engine == "behavioral"
    assert alert.detection.sequence_steps == ["process", "network", "file"]
    assert alert.detection.correlated_event_count == 3
    assert alert.alert.created == T.format(2)
    assert alert.process.name == "certutil.exe" and alert.rule.id == "det.behavioral.t1105_download_sequence"
    assert len(set(alert.src_doc.document_ids)) == 3
    again = Q.behavioral_alerts(events_df(spark, trio()[::-1])).first()
    assert again.alert.id == alert.alert.id


def _random_events(rng, n):
    docs = []
    for seq in range(n):
        kw = {
            "host": rng.choice(["H1", "H2", ""]),
            "ts": rng.choice(["bad", None, ""]) if rng.random() < 0.12 else T.format(rng.randrange(0, 12)),
            "entity": rng.choice(["", "", "a", "b"]),
            "pid": rng.choice([None, 7, 8]),
            "parent": rng.choice(["", "", "a"]),
        }
        make = rng.choice([download_process, download_network, download_file, run_key_process, run_key_write, proxy_process])
        if rng.random() < 0.4:
            kw["name"] = rng.choice(["", "certutil.exe", "rundll32.exe", "reg.exe"])
        docs.append(make(seq, **kw))
    return docs


def _facts(spark, docs):
    """Per event: position, context and the steps it fits, read from the library's own step predicates."""
    df = Q._slim(events_df(spark, docs), Q.SEQUENCES, "seq", "seq", None)
    out = {}
    for r in df.collect():
        e = out.setdefault(int(r.eid), {**r.asDict(), "fits": {}})
        e["fits"][r["def"]] = r.steps
    return out


def _linked(a, c):
    if a["entity"] and c["parent"] == a["entity"]:
        return True
    if a["entity"] and c["entity"]:
        return a["entity"] == c["entity"]
    if a["pid"] and a["name"] and (a["pid"], a["name"]) == (c["pid"], c["name"]):
        return True
    names_differ = a["name"] and c["name"] and a["name"] != c["name"]
    return not names_differ and bool(set(a["markers"]) & set(c["markers"]))


def _brute(spark, docs):
    events = sorted(_facts(spark, docs).values(), key=lambda e: (e["t"], e["o"]))
    result = []
    for n, d in enumerate(Q.SEQUENCES):
        for a in events:
            if d.required_steps[0] not in a["fits"].get(n, []):
                continue
            near = [
                c for c in events
                if c["host"] == a["host"] and _linked(a, c)
                and (not a["timed"] or not c["timed"] or 0 <= c["t"] - a["t"] <= d.window_seconds * 1_000_000)
            ]
            path = [a]

            def after(p, step):
                later = (c for c in near if (c["t"], c["o"]) > (p["t"], p["o"]) and step in c["fits"].get(n, []))
                return next((c for c in later if all(c is not x for x in path)), None)

            complete = True
            for step in d.required_steps[1:]:
                hit = after(path[-1], step)
                complete = hit is not None
                if not complete:
                    break
                path.append(hit)
            if complete:
                for step in d.optional_steps:
                    hit = after(a, step)
                    path += [hit] if hit is not None else []
                result.append((n, tuple(int(x["eid"]) for x in path)))
    return sorted(result)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    docs = _random_events(random.Random(seed), 90)
    expected = _brute(spark, docs)
    assert expected and found(spark, docs) == expected


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_unlimited_lookup_equals_brute_force(spark, depth):
    rng = random.Random(depth)
    rows = [(rng.choice("ab"), rng.choice([0, 0, rng.randrange(1, 60)]) * 1_000_000, o) for o in range(120)]
    rows = [(*r, rng.random() < 0.3) for r in rows]
    df = spark.createDataFrame(rows, "k string, t bigint, o bigint, is_probe boolean")
    probes = df.where("is_probe").withColumn("probe", F.struct("o")).select("k", "t", "o", "probe")
    cands = df.where("NOT is_probe").withColumn("cand", F.struct("o")).select("k", "t", "o", "cand")
    got = following.nearest_anywhere(probes, cands, ["k"], F.lit(7_000_000), depth)
    got = {r.probe.o: [c.o for c in r.found] for r in got.collect()}
    pool = sorted((r for r in rows if not r[3]), key=lambda r: r[1:3])
    want = {
        r[2]: [c[2] for c in pool if c[0] == r[0] and c[1:3] > r[1:3]][:depth] for r in rows if r[3]
    }
    assert got == want


def test_host_ordinals_are_dense(spark):
    docs = _random_events(random.Random(9), 60)
    rows = Q.host_ordinals(events_df(spark, docs), slice_seconds=60).collect()
    key = lambda r: (Q.UNKNOWN_HOST if not r.host.name else r.host.name)

    def when(r):
        try:
            return datetime.fromisoformat(r["@timestamp"].replace("Z", "+00:00")).timestamp()
        except (ValueError, AttributeError):
            return datetime(1970, 1, 1, tzinfo=timezone.utc).timestamp()

    for host in {key(r) for r in rows}:
        mine = sorted((r for r in rows if key(r) == host), key=lambda r: (when(r), r.seq))
        assert [r.host_ord for r in mine] == list(range(1, len(mine) + 1))


def test_lookups_carry_no_documents(spark, monkeypatch):
    seen = []
    within = following.nearest_within

    def watched(probes, candidates, *rest):
        seen.append(probes.schema["probe"].dataType.simpleString() + candidates.schema["cand"].dataType.simpleString())
        return within(probes, candidates, *rest)

    monkeypatch.setattr(following, "nearest_within", watched)
    match = Q.match_sequences(events_df(spark, trio())).first()
    assert len(seen) == 2 and not any("doc" in s for s in seen)
    assert [m.doc.stamp for m in match.matched] == [T.format(n) for n in range(3)]


def test_events_that_come_twice_match_once(spark):
    assert found(spark, trio() + trio()) == [(0, (1, 2, 3))]


@pytest.mark.parametrize("bits", [following.PROBED_BITS, 8])
def test_the_map_of_probed_keys_loses_no_row(spark, bits):
    rows = spark.sql("SELECT CASE WHEN id % 7 > 0 THEN cast(id % 400 AS string) END AS a, cast(id % 3 AS int) AS b, id FROM range(3000)")
    wanted = rows.where("a IS NULL OR a < '2'").select("a", F.col("b").cast("bigint").alias("b")).where("b = 1")
    kept = {r.id for r in following.maybe_among(rows, wanted, ["a", "b"], bits).collect()}
    exact = {r.id for r in rows.where("(a IS NULL OR a < '2') AND b = 1").collect()}
    assert exact == kept if bits > 8 else exact < kept
    assert following.maybe_among(rows, wanted.limit(0), ["a", "b"], bits).count() == 0
