from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from huntframe.llm import sharding as sh


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sh.op4_slot_shards(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    loads, places = defaultdict(int), defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(loads) == set(range(40))


def _loads(m):
    out = defaultdict(int)
    for r in m.collect():
        out[r.shard] += r.bytes
    return out


def test_rebalancing_moves_little_and_levels(spark):
    totals = spark.range(1, 400).select(F.col("id").cast("int").alias("slot"), (F.col("id") * 37 % 101 + 1).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    first = sh.first_map(spark, 8, 512)
    second = sh.rebalanced(first, totals, 8)
    assert second.count() == 512 and second.select("slot").distinct().count() == 512
    loads = _loads(second)
    assert max(loads.values()) - min(loads.values()) <= 101
    at = lambda m: {r.slot: r.shard for r in m.collect()}
    one, two = at(first), at(second)
    assert sum(one[k] != two[k] for k in one) < 100
    grown = sh.rebalanced(second, totals, 9)
    loads = _loads(grown)
    assert len(loads) == 9 and max(loads.values()) - min(loads.values()) <= 101
    three = at(grown)
    assert sum(two[k] == three[k] for k in two) >= 512 * 0.6


def test_edges(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, "b"), (2, "x" * 100000), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slots = [r[0] for r in df.select(sh.slot_of(F.col("doc_id"), F.col("text"))).collect()]
    assert slots[0] == slots[1] and slots[2] != slots[3]
    empty = df.limit(0).select("doc_id", F.lit(1).cast("long").alias("size"), F.lit(0).alias("virtual_slot"))
    m = sh.rebalanced(sh.first_map(spark), sh.slot_totals(empty))
    assert m.count() == sh.SLOTS and sh.placed(empty, m, ["doc_id"]).count() == 0
