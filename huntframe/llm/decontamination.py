"""Benchmark decontamination by winnowing.

A fingerprint is the hash of ``GRAM`` consecutive words that is the smallest in some window of ``SPAN - GRAM + 1`` such grams (the last one
among equals). Every run of ``SPAN`` words that a document shares with an item is one window in both, so both have the same fingerprint at
the same place in it. Fingerprints of documents are joined with those of items, and each pair is extended to both sides over
the words around it: a run of ``SPAN`` equal words or more makes a hit. Items of fewer than ``SPAN`` words are one window: all
their words, as one gram of their own length.

A document's fingerprints are looked up in a bitmap of all items' fingerprints first. Its size is fixed (``BITMAP_BITS``), so it can be
broadcast whatever the benchmark; only fingerprints that pass reach the join, with the hashes of the words around them. The items'
side is repeated over ``SALTS`` salts, so that a passage which many documents share is dealt over many tasks.

Words are compared by 64-bit hashes. Null texts have no words, an item without words has no window. Repeated rows of documents give repeated
results; rows of one item id count as one item, a null id as the empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.llm.arrow_text import slices
from huntframe.llm.storage import delete_since, mark, written, written_at
from huntframe.llm.word_hashes import ALPHANUMERIC, grams, words_of

SPAN = 10
GRAM = 5
BITMAP_BITS = 1 << 24
SALTS = 16

_HIT = pa.struct(
    [("size", pa.int32()), ("print", pa.int64()), ("at", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]
)
_HIT_SQL = "struct<size:int,print:bigint,at:int,left:array<bigint>,right:array<bigint>>"


def fingerprints(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen grams and the hashes of all grams."""
    made, _ = grams(hashes, rows, GRAM)
    width = SPAN - GRAM + 1
    size = len(hashes) - SPAN + 1
    if size <= 0:
        return np.zeros(0, np.int64), made
    best, at = made[width - 1 : width - 1 + size].copy(), np.arange(width - 1, width - 1 + size)
    for back in range(width - 2, -1, -1):
        other = made[back : back + size]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + back
    return np.unique(at[rows[:size] == rows[SPAN - 1 : SPAN - 1 + size]]), made


def _entries(column: pa.Array, wanted) -> tuple[list[int], list[list[dict]]]:
    """Per row the number of words, and the fingerprints that ``wanted(size, hashes, positions, words per row, rows)`` chooses."""
    counts, found = [], []
    for first, last, data, starts in slices(column):
        hashes, rows = words_of(data, starts, ALPHANUMERIC)
        begin = np.searchsorted(rows, np.arange(last - first + 1))
        counts += np.diff(begin).tolist()
        entries: list[list[dict]] = [[] for _ in range(last - first)]
        signed = hashes.view(np.int64)
        for size, made, at in wanted(hashes, rows, begin):
            reach = SPAN - GRAM if size == SPAN else 0
            full = SPAN if size == SPAN else size
            for p, h in zip(at.tolist(), made[at].view(np.int64).tolist(), strict=True):
                row = int(rows[p])
                a, b = int(begin[row]), int(begin[row + 1])
                left = signed[max(a, p - reach) : p][::-1].tolist()
                entries[row].append({"size": size, "print": h, "at": p - a, "left": left, "right": signed[p : min(b, p + full)].tolist()})
        found += entries
    return counts, found


def _with_entries(df: DataFrame, key: str, text: str, wanted) -> DataFrame:
    """``key, n_words, hits``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, found = _entries(batch.column(1), wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_HIT))], names=["key", "n_words", "hits"]
            )

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"key {kind}, n_words long, hits array<{_HIT_SQL}>"
    )


def item_fingerprints(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, size, print, left, right``: one row per fingerprint of each item."""

    def wanted(hashes, rows, begin):
        at, made = fingerprints(hashes, rows)
        yield SPAN, made, at
        lengths = np.diff(begin)
        for size in range(1, SPAN):
            short = begin[:-1][lengths == size]
            if len(short):
                yield size, grams(hashes, rows, size)[0], short

    made = _with_entries(items, key, text, wanted)
    return made.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("item"), F.explode("hits").alias("h")).select(
        "item", "h.size", "h.print", "h.left", "h.right"
    )


def _bit(size: np.ndarray | int, prints: np.ndarray) -> np.ndarray:
    return (prints.astype(np.uint64) % np.uint64(BITMAP_BITS)).astype(np.int64)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """One bit per slot of a table of slots ``b``."""
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for batch in slots.select(F.col("b").cast("int")).distinct().toArrow().column("b").chunks:  # BITMAP_BITS rows at most
        b = batch.to_numpy()
        np.bitwise_or.at(bits, b >> 3, (1 << (b & 7)).astype(np.uint8))
    return bits


def document_hits(docs: DataFrame, prints: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_words, hits``: of each document the fingerprints that the bitmap of the items' ones has."""
    bits = _bitmap(prints.select(F.pmod(F.col("print"), F.lit(BITMAP_BITS)).alias("b")))
    sizes = sorted(r[0] for r in prints.select("size").distinct().collect())  # SPAN rows at most
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def wanted(hashes, rows, begin):
        has = shared.value
        for size in sizes:
            if size == SPAN:
                at, made = fingerprints(hashes, rows)
            else:
                made, whole = grams(hashes, rows, size)
                at = np.flatnonzero(whole)
            b = _bit(size, made[at])
            yield size, made, at[(has[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]

    return _with_entries(docs, key, text, wanted)


def _equal(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, contaminated`` per document row; ``items`` are the ids as sorted strings."""
    prints = written(item_fingerprints(items, item_key, item_text), "item-prints")
    marked = document_hits(docs, prints, key, text).withColumn("row", F.monotonically_increasing_id())
    marked = written(marked, "document-prints")  # from here on a row's number is fixed
    salt = F.array([F.lit(i) for i in range(SALTS)])
    spread = prints.withColumn("salt", F.explode(salt)).select(
        "item", "size", "print", "salt", F.col("left").alias("item_left"), F.col("right").alias("item_right")
    )
    hits = marked.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    pairs = hits.join(spread, ["size", "print", "salt"]).select(
        "row", "item", "size", "at", _equal(F.col("left"), F.col("item_left")).alias("back"), _equal(F.col("right"), F.col("item_right")).alias("ahead")
    )
    pairs = written(pairs.filter(F.col("back") + F.col("ahead") >= F.col("size")), "hits")
    spans = pairs.select("row", (F.col("at") - F.col("back")).alias("a"), (F.col("at") + F.col("ahead") - 1).alias("b")).distinct()
    words = spans.select("row", F.explode(F.sequence("a", "b")).alias("w")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = pairs.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.lit(0).cast("long")
    return (
        marked.select("row", "key", "n_words").join(words, "row", "left").join(found, "row", "left")
        .select(
            F.col("key").alias(key), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce(F.size("items"), none).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows whose text has no hit, with their own columns. Equal texts share a verdict, so texts are matched by digest.

    A bitmap of fixed size over the hashes of bad texts lets the other rows pass where they stand; only rows it marks, the bad ones and a few
    others, are joined with the digests.
    """
    spark, digest = docs.sparkSession, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(BITMAP_BITS))
    keyed = docs.select(F.struct(digest.alias("digest"), slot.alias("slot")).alias("key"), F.col(f"`{text}`").alias("text"))
    ids = items.select(F.col(f"`{item_text}`").alias("text"), F.lit(0).alias("item_id"))
    point = mark()
    bad, path = written_at(contamination(keyed, ids, "key").filter("contaminated").select("key.*").distinct(), "contaminated")
    delete_since(spark, point, keep=path)
    bits = spark.sparkContext.broadcast(_bitmap(bad.select(F.col("slot").alias("b"))))

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        b = slots.to_numpy()
        return pd.Series((bits.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    name, flag = "_digest", "_marked"
    while name in docs.columns or flag in docs.columns:
        name, flag = name + "_", flag + "_"
    flagged = docs.withColumn(flag, marked(slot))
    maybe = flagged.filter(F.col(flag)).withColumn(name, digest).join(bad.select(F.col("digest").alias(name)), name, "left_anti")
    return flagged.filter(~F.col(flag)).select(*docs.columns).unionByName(maybe.select(*docs.columns))


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT r, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND places.g = windows.g
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
