"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, under a softmax.

A document's tokens are its words (runs between blanks, case kept), the character n-grams of each word with a mark at both its ends, a mark for each word that
equals the one before it, and one end mark, so every text has a token. Words and n-grams share ``BUCKETS`` vectors by hash.

Training is stochastic gradient descent, one document a step, over a sample of at most ``TRAIN_ROWS`` labelled documents: those of the smallest id
hashes. The sample is dealt by id hash into ``SHARDS``; in each of ``ROUNDS`` rounds a Spark task walks through each shard from the shared vectors, and the
driver averages what they changed, each vector over the shards that met it. Nothing depends on how tables are partitioned.

Scoring reads every row whole. As the output is linear in the averaged vector, each token's vector is reduced to its share of the output first, and a document's
score is the sigmoid of the mean share of its tokens.

Null and empty texts have the end mark only. Labels other than 0 and 1 are ignored; an id with several label rows has the label of most of them (1 if equal), an
id with several documents is trained on its smallest text. Without usable labels all scores are 0.5. Repeated rows are scored each. Only named
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntframe.llm import storage
from huntframe.llm.arrow_text import slices
from huntframe.llm.word_hashes import U64, mixed, powers

BUCKETS = 1 << 18
DIMENSIONS = 8
SIZES = (3, 4)
TRAIN_ROWS = 6000
SHARDS = 4
ROUNDS = 5
RATE = 3.0
ACCEPT = 0.3
FOLDS = 5

END, AGAIN = BUCKETS, BUCKETS + 1
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) & U64(BUCKETS - 1)).astype(np.int32)


def tokens(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some texts' tokens but the end marks, kind by kind: the buckets in order of rows, and where each row's tokens start, with their end."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    starts = before[starts]
    edge = np.zeros(len(points) + 1, bool)
    edge[starts] = True
    at = np.flatnonzero((points != 32) & ((points < 9) | (points > 13)))
    new = edge[at]
    new[:1] = True
    new[1:] |= at[1:] != at[:-1] + 1
    place = np.arange(len(at)) + np.cumsum(new)
    marked = np.zeros(len(at) + int(new.sum()) + 1, U64)  # words with a zero before, between and after them
    marked[place] = points[at] + np.uint32(1)
    begin = place[new]
    end = np.append(begin[1:] - 1, len(marked) - 1)[: len(begin)]
    sums = np.zeros(len(marked) + 1, U64)
    np.cumsum(marked * powers(len(marked), _BASE), out=sums[1:])
    words = (sums[end] - sums[begin]) * powers(len(marked) + 1, _INVERSE)[begin]
    row = np.searchsorted(starts, at[new], "right") - 1
    first = np.searchsorted(row, np.arange(len(starts)))
    yield _bucket(words), first
    same = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    again = np.concatenate([np.zeros(min(len(words), 1) + 1, np.int64), np.cumsum(same)]) if len(words) else np.zeros(1, np.int64)
    yield np.full(int(same.sum()), AGAIN, np.int32), again[first]
    left = np.append(begin - 1, len(marked) - 1)[first]
    for size in SIZES:
        n = max(len(marked) - size + 1, 0)
        hashes, inside = np.full(n, size, U64), np.ones(n, bool)
        for i in range(size):
            hashes = hashes * U64(_BASE) + marked[i : i + n]
            if 0 < i < size - 1:
                inside &= marked[i : i + n] != 0
        count = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(inside, out=count[1 : n + 1])
        count[n + 1 :] = count[n]
        yield _bucket(hashes[inside]), count[left]


def _weights(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's different buckets and their shares of its tokens."""
    for _, _, data, starts in slices(column):
        kinds = list(tokens(data, starts))
        for row in range(len(starts) - 1):
            met = np.concatenate([b[s[row] : s[row + 1]] for b, s in kinds] + [np.array([END], np.int32)])
            used, n = np.unique(met, return_counts=True)
            yield used, (n / len(met)).astype(np.float32)


def _shares(column: pa.Array, share: np.ndarray) -> np.ndarray:
    """The mean share of each text's tokens."""
    means = []
    for _, _, data, starts in slices(column):
        total, n = np.full(len(starts) - 1, share[END]), np.ones(len(starts) - 1)
        for buckets, first in tokens(data, starts):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(share[buckets], out=sums[1:])
            total += sums[first[1:]] - sums[first[:-1]]
            n += np.diff(first)
        means.append(total / n)
    return np.concatenate(means) if means else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``shard, place, label, buckets, shares`` of the sample, written once."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    known = known.groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    place = F.xxhash64(F.col("key").cast("string"))
    sample = known.select("key", "label", place.alias("place")).orderBy("place", F.col("key").cast("string")).limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "key").groupBy("key", "place", "label").agg(F.min("text").alias("text"))  # `rows` rows at most
    schema = "place long, label int, buckets array<int>, shares array<float>"

    def run(batches):
        for batch in batches:
            made = list(_weights(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([u for u, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float32()))],
                names=["place", "label", "buckets", "shares"],
            )

    made = found.select("place", "label", "text").mapInArrow(run, schema)
    return storage.written(made.withColumn("shard", F.pmod("place", F.lit(SHARDS)).cast("int")), "training")


def _walk(batches, vectors: np.ndarray, output: np.ndarray, rate: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """One pass over each shard, whose rows come one shard after the other: the shard, met buckets, their vectors and the output's weights."""
    shard, own, out, met = None, vectors, output, np.zeros(len(vectors), bool)
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            at = columns[0][i].as_py()
            if at != shard:
                if shard is not None:
                    yield shard, np.flatnonzero(met), own[met], out
                shard, own, out, met = at, vectors.copy(), output.copy(), np.zeros(len(vectors), bool)
            used, weight = columns[2][i].values.to_numpy(), columns[3][i].values.to_numpy()
            hidden = weight @ own[used]
            logits = out @ hidden
            chances = np.exp(logits - logits.max())
            error = chances / chances.sum()
            error[columns[1][i].as_py()] -= 1
            back = error @ out
            own[used] -= rate * np.outer(weight, back)
            out -= rate * np.outer(error, hidden)
            met[used] = True
    if shard is not None:
        yield shard, np.flatnonzero(met), own[met], out


def fit(sample: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Each bucket's share of the output (log odds of label 1)."""
    random = np.random.default_rng(11)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 2, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    context = sample.sparkSession.sparkContext
    ordered = sample.select("shard", "label", "buckets", "shares", "place").repartition(SHARDS, "shard").sortWithinPartitions("shard", "place")
    for number in range(rounds):
        shared = context.broadcast((vectors, output, rate * (1 - number / rounds)))

        def walk(batches, shared=shared):
            for shard, met, own, out in _walk(batches, *shared.value):
                packed = [pa.array([a.tobytes()], pa.binary()) for a in (met.astype(np.int32), own, out)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *packed], names=["shard", "met", "own", "out"])

        changes = sorted(ordered.mapInArrow(walk, "shard int, met binary, own binary, out binary").collect())  # SHARDS rows
        shared.unpersist()
        if not changes:
            break
        total, times = np.zeros_like(vectors), np.zeros(len(vectors), np.float32)
        for c in changes:
            met = np.frombuffer(c.met, np.int32)
            total[met] += np.frombuffer(c.own, np.float32).reshape(-1, DIMENSIONS)
            times[met] += 1
        vectors[times > 0] = total[times > 0] / times[times > 0, None]
        output = np.mean([np.frombuffer(c.out, np.float32).reshape(2, DIMENSIONS) for c in changes], axis=0)
    return (vectors @ (output[1] - output[0])).astype(np.float64)


def score(docs: DataFrame, share: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(share)

    def run(batches):
        for batch in batches:
            scores = 1 / (1 + np.exp(-np.clip(_shares(batch.column(1), shared.value), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["key", "score"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether an id belongs to the fold that is never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def op11_subword_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    share = fit(training_rows(docs, labels.filter(~held_out(F.col("doc_id")))))
    return score(docs, share).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )
