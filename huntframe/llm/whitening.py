"""Whitening of embeddings along the principal components of their covariance.

Entries become whole numbers, ``floor(64 * c) + 1000000``, so sums are exact. Tasks sum vectors, then products of centred vectors; Spark adds up what the
tasks yield, one number per dimension or pair of dimensions. ``spectral.eigen`` finds the components of that matrix, and the rows are projected with the
broadcast components.

Rows without a vector, or with null or non-finite entries, are left out, and so are vectors whose length is not the most frequent one (the longest among
equals). Numbers beyond 62 bits are held at that bound. A component without variance (at most 1e-13 of the whole) has no whitened value (null) and no part
in the identity error. Repeated rows count each; a table without vectors gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm.spectral import eigen

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
_BOUND = 1 << 62
_FLAT = 1e-13
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What the fit list tells: number of vectors, exact sums, components as columns, their variances, and the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def kept(self) -> np.ndarray:
        """Which components have variance."""
        return self.variances > _FLAT * self.trace

    @property
    def projection(self) -> np.ndarray:
        return self.components[:, self.kept] / np.sqrt(self.variances[self.kept])

    def explained(self) -> list[float]:
        return [max(float(v), 0.0) / self.trace if self.trace > 0 else 0.0 for v in self.variances]


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector``: the rows with a whole vector of finite doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = df.select(F.col(f"`{key}`").alias("key"), v.alias("vector"))
    bad = F.exists("vector", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return whole.filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _whole_numbers(column: pa.Array, size: int):
    """Blocks of rows as matrices of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    for i in range(0, len(flat), _ROWS):
        low = np.clip(np.floor(flat[i : i + _ROWS] * SCALE), -float(_BOUND), float(_BOUND))
        yield low.astype(np.int64) + SHIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns beyond 64 bits: halves of numbers don't overflow."""
    high, low = x >> 31, x & ((1 << 31) - 1)
    return [(int(h) << 31) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def _sums(rows: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0))])

    def run(batches):
        n, totals = 0, [0] * size
        for batch in batches:
            for x in _whole_numbers(batch.column(0), size):
                n += len(x)
                totals = [a + b for a, b in zip(totals, _exact_sums(x), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(totals, pa.decimal128(38, 0))], names=schema.names
            )

    added = rows.select("vector").mapInArrow(run, schema).groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = {r["at"]: r for r in added.collect()}  # one row per dimension
    return found[0]["n"], tuple(int(found[i]["total"]) for i in range(size))


def _products(rows: DataFrame, size: int, n: int, mean: np.ndarray, project: np.ndarray | None = None, middle: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor ``n``, of the vectors less ``mean``, or of their projections less ``middle``."""
    wide = size if project is None else project.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((mean, project, middle))
    upper = np.triu_indices(wide)

    def run(batches):
        mean, project, middle = shared.value
        total = np.zeros((wide, wide))
        for batch in batches:
            for x in _whole_numbers(batch.column(0), size):
                y = x - mean
                if project is not None:
                    y = y @ project - middle
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in upper] + [pa.array(total[upper])], names=["i", "j", "s"])

    added = rows.select("vector").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((wide, wide))  # one number per pair of dimensions
    out[added.column("i").to_numpy(), added.column("j").to_numpy()] = added.column("s").to_numpy() / n
    return np.triu(out) + np.triu(out, 1).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows of the usual length and what they tell; None without any."""
    usual = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None or usual["size"] == 0:
        return rows.limit(0), None
    size = usual["size"]
    rows = rows.filter(F.size("vector") == size)
    n, sums = _sums(rows, size)
    covariance = _products(rows, size, n, np.array([s / n for s in sums]))
    values, found = eigen(covariance)
    return rows, Whitening(n, sums, found[:, :components], values[:components], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    left = np.array([float(Fraction(s, model.n) - Fraction(m)) for s, m in zip(model.sums, model.mean.tolist(), strict=True)])
    projection = model.projection
    if not projection.shape[1]:
        return 0.0
    got = _products(rows, len(model.sums), model.n, model.mean, projection, left @ projection)
    return float(np.abs(got - np.eye(len(got))).max())


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of ``(n * x - sum)^2``, exact: in 64 bits where the numbers allow it, else in whole numbers of any size."""
    reach = [n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + abs(s) for s in sums]
    if max(reach) < 1 << 62:
        u = n * x - np.array(sums, np.int64)
        if sum(int(m) ** 2 for m in np.abs(u).max(axis=0, initial=0)) < 1 << 62:
            return np.einsum("ij,ij->i", u, u).tolist()
        high, low = u >> 20, u & ((1 << 20) - 1)
        if np.abs(high).max(initial=0) < 1 << 26:
            parts = [np.einsum("ij,ij->i", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))]
            return [(a << 40) + (b << 21) + c for a, b, c in zip(*parts, strict=True)]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``key, deviation, whitened``: per row the exact squared distance (times n squared) from the mean and the whitened components."""
    size, shared = len(model.sums), rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean, model.projection))
    schema = T.StructType(
        [rows.schema["key"], T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )

    def run(batches):
        n, sums, mean, projection = shared.value
        for batch in batches:
            done = 0
            for x in _whole_numbers(batch.column(1), size):
                z = (x - mean) @ projection
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                deviation = pa.array([str(d) for d in _deviation(x, n, sums)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(x)), deviation, lists], names=schema.names)
                done += len(x)

    return rows.select("key", "vector").mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation as decimal(38, 0))"))


_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: one row per vector and component. A deviation beyond 64 bits is null."""
    rows, model = fit(vectors(df, key, vector), components)
    if model is None:
        name = T.StructType([T.StructField(key, df.schema[key].dataType)])
        return df.sparkSession.createDataFrame([], T.StructType(name.fields + T._parse_datatype_string(_SCHEMA).fields))
    error = identity_error(rows, model)
    made = whiten(rows, model)
    shares = F.array(*[F.lit(e) for e in model.explained()])
    numbers = F.sequence(F.lit(1), F.lit(len(model.variances)))
    return made.select("key", "deviation", "whitened", F.explode(numbers).alias("component")).select(
        F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.get("whitened", F.col("component") - 1).alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
