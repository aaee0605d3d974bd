from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from huntframe.llm import suffix_dedup as sd


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def make_rows(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    pool = [text(rng.choice([15, 30, 45, 90])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else text(rng.randrange(40)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 300), (103, "ab" * 100), (104, rows[5][1]), (105, rows[5][1]), (106, rows[7][1]), (106, rows[7][1]), (None, rows[8][1])]
    return rows


@pytest.mark.parametrize(("length", "gram", "group", "piece"), [(30, 15, 4096, 1 << 18), (30, 9, 3, 64), (64, 1, 4096, 100)])
def test_equals_brute_force(spark, monkeypatch, length, gram, group, piece):
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "PIECE", piece)
    monkeypatch.setattr(sd, "BATCH", 40)
    rows = make_rows(length + gram)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name int").repartition(3)
    got = sorted(map(tuple, sd.without_repeats(df, length=length, gram=gram).collect()), key=repr)
    assert got == brute(rows, length)


def test_deep_shallow_orders_like_sorting():
    rng = random.Random(2)
    base = bytes(rng.choice(b"ab\0") for _ in range(60))
    texts = [base[: rng.randrange(60)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(4))) for _ in range(400)] + [b"", b"", b"\0", b"\0\0"]
    order, shared = sd.deep_shallow(texts, shallow=2)
    assert [texts[i] for i in order] == sorted(texts)
    for k in range(1, len(texts)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert a[: shared[k]] == b[: shared[k]] and (shared[k] == min(len(a), len(b)) or a[shared[k]] != b[shared[k]])
    assert len(sd.deep_shallow([])[0]) == 0


def test_anchors_depend_on_content_alone():
    rng = random.Random(3)
    for _ in range(50):
        data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(300)), np.uint8)
        at, hashes, first, last = sd.anchors(data, 20, 6)
        whole = sd._gram_hashes(data, 6)
        starts = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
        assert starts == list(range(300 - 19))
        for p, h, a, b in zip(at, hashes, first, last, strict=True):
            for s in range(a, b + 1):
                assert p == s + np.argmin(whole[s : s + 15]) and h == whole[p]


def test_empty_and_bodies(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, "b")], "doc_id long, text string")
    assert sd.without_repeats(df.limit(0)).count() == 0
    assert {r.doc_id: bytes(r.kept) for r in sd.without_repeats(df, bodies=True).collect()} == {1: b"", 2: b"b"}


def test_query_goes_by_bytes_not_by_words(spark, tmp_path):
    rng = random.Random(4)
    text = lambda words: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 11))) for _ in range(words))
    passages = [text(n) for n in range(51, 101, 7)] + ["é" * 30 + text(200).encode("ascii", "ignore").decode()[: n - 60] for n in (399, 400, 401)]
    rows = [(2 * i + k, f"{text(80)}{edge}{p}{edge}{text(80)}") for i, p in enumerate(passages) for k, edge in enumerate("<>")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sd.op6_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(rows, sd.LENGTH)
    sizes = [len(p.encode()) for p in passages]
    assert sizes[-3:] == [399, 400, 401] and min(sizes[:-3]) < 400 < max(sizes[:-3])
    for r in found:
        size = sizes[r.doc_id // 2]
        assert (r.n_removed, r.n_spans, r.has_repeats) == ((size, 1, True) if size >= 400 else (0, 0, False))


def test_a_run_is_one_row_of_its_text(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefé") for _ in range(n))
    rows = [(i, word(300) + "x" * (900 + 100 * i) + word(300)) for i in range(6)] + [(10, "-=" * 700), (11, word(80) + "-=" * 400), (12, "x" * 399), (13, "y" * 401)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    places = [p for r in sd._anchor_rows(df, 400, 200).collect() for p in r.places]
    grams = Counter(p.gram for p in places)
    # six runs of x, each with its inside and two edges: a gram has few rows, whatever the length of the runs
    assert max(grams.values()) <= 3 * 6
    all_at = lambda text: sd.anchors(np.frombuffer(text.encode(), np.uint8), 400, 200)[0].tolist()
    assert sorted(a for p in places for a in p[-1]) == sorted(a for _, t in rows for a in all_at(t))
    assert sorted(map(tuple, sd.without_repeats(df, key="key").collect()), key=repr) == brute(rows, 400)
