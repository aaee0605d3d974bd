from __future__ import annotations

import math

import numpy as np
import pytest

from huntframe.llm import whitening as wh
from huntframe.llm.spectral import eigen, polar_factor


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "one large", "pairs", "graded", "rank one", "diagonal", "equal", "zero"])
def test_eigenvectors(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = {
        "random": rng.random(size), "one large": np.r_[1e6, rng.random(size - 1)], "pairs": np.repeat(rng.random(size), 2)[:size],
        "graded": 10.0 ** -np.linspace(0, 12, size), "rank one": np.r_[1.0, np.zeros(size - 1)], "diagonal": np.arange(size) + 1.0,
        "equal": np.full(size, 3.0), "zero": np.zeros(size),
    }[kind]
    a = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    got, vectors = eigen(a)
    scale = max(abs(values).max(), 1e-300)
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-12 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * scale


def test_polar_factor():
    a = np.diag([3.0, -2.0, 1e-9, -1e-12])
    assert np.allclose(polar_factor(a), np.diag([1.0, -1, 1, -1]), atol=1e-12)


def brute(rows):
    """The contract with exact whole numbers, and the library's eigenvectors."""
    kept = [(k, v) for k, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = [[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[a - s / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:32]
    e, z = values[order], (y @ vectors[:, order]) / np.sqrt(np.maximum(values[order], 1e-300))
    return [(k, n, sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for (k, _), r in zip(kept, x, strict=True)], z, e / values.sum()


def same(got, rows):
    exact, z, explained = brute(rows)
    width = z.shape[1]
    by_key = {}
    for r in got:
        by_key.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(exact) * width
    signs = None
    for (key, n, deviation), line in zip(exact, z, strict=True):
        found = sorted(by_key[key], key=lambda r: r.component)[:width]
        assert [r.component for r in found] == list(range(1, width + 1))
        assert {(r.n, r.deviation) for r in found} == {(n, deviation)}
        ours = np.array([r.whitened for r in found])
        signs = np.sign(ours * line) if signs is None else signs
        assert np.allclose(ours * signs, line, atol=1e-7)
        assert np.allclose([r.explained for r in found], explained, rtol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(40) * np.linspace(3, 0.2, 40)).tolist()) for i in range(300)]
    bad = [(1000, None), (1001, [None] * 40), (1002, [math.nan] * 40), (1003, [math.inf] + [0.0] * 39), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows + bad], "vec_id long, embedding array<float>, component string, key int").repartition(5)
    same(wh.whitened_components(df).collect(), rows)


def test_query_on_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same(wh.op13_whitening(spark, sf_dir).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_tables(spark):
    schema = "vec_id string, embedding array<float>"
    assert wh.whitened_components(spark.createDataFrame([], schema)).count() == 0
    assert wh.whitened_components(spark.createDataFrame([("a", None), ("b", [])], schema)).count() == 0
    one = wh.whitened_components(spark.createDataFrame([("a", [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0, 0), (2, 1, 0, None, 0, 0)]
    line = [(None, [float(i), 2.0 * i, 7.0]) for i in range(9)] * 2
    got = wh.whitened_components(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 54 and {r.component for r in got if r.whitened is None} == {2, 3}
    huge = wh.whitened_components(spark.createDataFrame([("a", [3e38, 1.0]), ("b", [-3e38, 2.0])], schema)).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)


def test_deviations_of_any_size():
    rng = np.random.default_rng(1)
    for n, reach in ((10, 100), (10**7, 10**6), (10**12, 10**4), (10**15, 2**61)):
        x = rng.integers(-reach, reach, (20, 8))
        sums = tuple(int(s) * n // 20 for s in x.sum(axis=0, dtype=object))
        assert wh._deviation(x, n, sums) == [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    assert wh._exact_sums(np.full((5, 2), -(2**62) + 3)) == [5 * (3 - 2**62)] * 2
