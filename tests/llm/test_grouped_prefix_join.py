from __future__ import annotations

import random
import re

import pytest

from huntframe.llm import grouped_prefix_join as g
from huntframe.llm.components import components


def brute(rows, percent=85):
    def shingles(text):
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        w = [x for x in text.split(" ") if x]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys) if keys else None))
    return sorted(out, key=repr)


def make_rows(seed, bases, copies, length):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(400)}"
    common = [word() for _ in range(30)]
    rows, key = [], 0
    for _ in range(bases):
        base = [word() for _ in range(rng.randrange(5, length))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.4:
                w = w + common
            rows.append((key, rng.choice([" ", "\n", "  "]).join(w)))
            key += rng.choice([1, 3])
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (905, "a b c d"), (None, "a b c d"), (None, "lonely text here now"), (906, "w " * 60000)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and bands, prefixes beyond the counted shingles, sets that a task forgets
        monkeypatch.setattr(g, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(g, "COUNTED", 0.5)
        monkeypatch.setattr(g, "REMEMBERED", 2)
    rows = make_rows(3, 12, 22, 220) + EDGE
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(4)
    got = sorted((tuple(r)[:3] for r in g.joined_documents(df).collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) * 0.8


def test_leaders_stay(spark):
    rows = make_rows(5, 6, 6, 120) + EDGE
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, same int")
    kept = g.one_of_each(df)
    assert kept.columns == df.columns
    want = {k for k, n, c in brute(rows) if k == c}
    assert {r.doc_id for r in kept.collect()} == want
    assert g.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def links(rows, percent=85):
    """Per row, how many other rows it links to."""
    sets = []
    for _, text in rows:
        w = re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if c.isascii() else c for c in text or "").strip(" \t\n\x0b\x0c\r"))
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return [(key, sum(near(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_link_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK_SHINGLES", block)
    rows = make_rows(3, 12, 22, 220) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_links) for r in g.joined_documents(df).collect()), key=repr)
    want = links(rows)
    assert got == sorted(want, key=repr)
    assert max(n for _, n in want) > 5


@pytest.mark.parametrize("kind", ["chain", "stars"])
def test_components_edges_shrink(spark, monkeypatch, kind):
    """Each round joins only what is left of the edges, not all of them."""
    from huntframe.llm import components as module

    rng = random.Random(kind)
    if kind == "chain":
        edges = [(i, i + 1) for i in range(1500)]
    else:  # a group of near copies, tied to the pivots of several buckets
        edges = [(p, rng.randrange(10, 600)) for p in range(8) for _ in range(400)] + [(1000, 1001), (1001, 1001), (1002, 1002)]
    sizes, real = [], module.written_at

    def spy(df, label):
        made = real(df, label)
        if label.endswith("-edges"):
            sizes.append(made[0].count())
        return made

    monkeypatch.setattr(module, "written_at", spy)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want: dict[int, int] = {}
    for root in sorted({x for a, b in edges if a != b for x in (a, b)}):
        stack = [root] if root not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = root
                stack += [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
    assert found == want
    assert len(sizes) > 1 and sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))
    assert sum(sizes) <= 3 * sizes[0]
