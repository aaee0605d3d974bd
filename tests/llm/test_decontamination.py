from __future__ import annotations

import random
import re

from huntframe.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add("" if item is None else str(item))
        out.append((key, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "B", "c1", "é", "dd", "Ee"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (None, "x y"), (7, "zz top"), (7, "zz top")]
    docs = [(i, text(rng.choice([0, 5, 40, 200]))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x y x y"), (102, "x y x y"), (None, "zz TOP"), (103, "q " * 50000 + (items[4][1] or ""))]
    docs += [(200 + i, f"u{i} {items[5][1]} v{i}") for i in range(30)]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, print int")
    got = sorted(((*r[:4], list(r[4]), r[5]) for r in dc.contamination(d, b).collect()), key=repr)
    assert got == brute(docs, items)
    kept = dc.clean_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        ((k, t) for (k, t) in docs if not brute([(k, t)], items)[0][-1]), key=repr
    )


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(d.limit(0), b).count() == 0
    assert [tuple(r) for r in dc.contamination(d, b.limit(0)).collect()] == [(1, 2, 0, 0, [], False)]
