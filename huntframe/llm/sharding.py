"""Sharding by fixed virtual slots, in DataFrame functions only.

Every record hashes into one of ``SLOTS`` virtual slots, for good. A map with one row per slot says which shard holds it; maps are
stored by version. The first version deals slots out in turn. Rebalancing sums the bytes of each slot and edits the map: a shard keeps
its largest slots up to the mean, and the small ones beyond it move to whatever shard is lightest, largest first. So few
records move, and shard sizes end up near equal (law ``bytes``) as long as no slot outweighs a shard. Adding shards is the
same edit with more shards, the new ones empty.

The slot comes from the key, or for a null key from the text. Equal texts with different keys spread over the slots; rows that repeat
key and text share one. Null texts count as empty. Only the map (``SLOTS`` rows, a fixed number) is gathered or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huntframe.llm.arrow_text import beside
from huntframe.llm.storage import shared_path, written

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
MAP_SCHEMA = "slot int, shard int, bytes long, rows long"


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: the first 32 bits of an MD5 digest of its key, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_totals(rows: DataFrame) -> DataFrame:
    """``slot, bytes, rows`` of rows with ``virtual_slot`` and ``size``; sums are combined in each task first."""
    return rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Slots in turn; no sizes yet."""
    slot = F.col("id").cast("int")
    none = F.lit(0).cast("long")
    return spark.range(slots).select(slot.alias("slot"), (slot % shards).alias("shard"), none.alias("bytes"), none.alias("rows"))


def rebalanced(old: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited to present sizes and the given number of shards. A map of fixed length is all that is gathered."""
    sized = old.select("slot", "shard").join(F.broadcast(totals), "slot", "left").na.fill(0, ["bytes", "rows"])
    whole = Window.partitionBy()
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = sized.withColumn("mean", F.sum("bytes").over(whole) / shards).withColumn("up_to", F.sum("bytes").over(own))
    stays = (F.col("shard") < shards) & ((F.col("up_to") <= F.col("mean")) | (F.col("bytes") == 0))
    marked = marked.withColumn("stays", stays)
    entry = F.struct((-F.col("bytes")).alias("less"), "slot", "rows")
    gathered = marked.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), entry))).alias("moving"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)) for i in range(shards)]).alias("loads"),
    )
    lightest = lambda loads: F.array_position(loads, F.array_min(loads)).cast("int") - 1
    start = F.struct(F.col("loads"), F.array().cast("array<struct<slot:int,shard:int,bytes:bigint,rows:bigint>>").alias("placed"))

    def place(state, one):
        to = lightest(state.loads)
        put = F.struct(one.slot.alias("slot"), to.alias("shard"), (-one.less).alias("bytes"), one.rows.alias("rows"))
        loads = F.transform(state.loads, lambda x, i: F.when(i == to, x - one.less).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state.placed, F.array(put)).alias("placed"))

    moved = gathered.select(F.explode(F.aggregate("moving", start, place, lambda s: s.placed)).alias("m")).select("m.*")
    return marked.filter("stays").select("slot", "shard", "bytes", "rows").unionByName(moved)


class SlotMaps:
    """Map versions in one folder, each written once under its number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, version: int, slot_map: DataFrame) -> DataFrame:
        slot_map.coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")


def placed(rows: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard, gapless from 0.

    The place is the number of rows in the shard's earlier slots, from the map, plus the row's place in its own slot. So
    no task sorts more than one slot's rows. Where the rows have a ``shard`` or ``slot`` of their own, the new one gets a ``_`` at its end.
    """
    number, offset, shard, slot = beside(rows.columns, "_number", "_offset", "shard", "slot")
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select(
        F.col("slot").alias("virtual_slot"), F.col("shard").alias(shard), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(offset)
    )
    within = Window.partitionBy("virtual_slot").orderBy(*order)
    numbered = rows.withColumn(number, F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), "virtual_slot").withColumn(slot, F.col(offset) + F.col(number)).drop(offset, number)


def op4_slot_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text")).alias("virtual_slot"),
    )
    maps = SlotMaps(spark, shared_path(spark, "slot-map"))
    first = maps.store(1, first_map(spark))
    current = maps.store(2, rebalanced(first, written(slot_totals(rows), "slot-totals")))
    return placed(rows, current, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


SQL = rf"""
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 8))::BIGINT % {SLOTS} AS virtual_slot
  FROM documents
), bytes AS (
  SELECT doc_id, virtual_slot, strlen(text) + {ROW_BYTES} AS size,
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT)) AS b
  FROM d
), r AS (
  SELECT doc_id, virtual_slot, size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, polynomial
), m AS (
  SELECT virtual_slot, virtual_slot % {SHARDS} AS shard, sum(size)::BIGINT AS bytes, count(*) AS n FROM r GROUP BY 1
), k AS (
  SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING)
    <= (sum(bytes) OVER ()) / {SHARDS} AS stays
  FROM m
), moving AS (
  SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS step FROM k WHERE NOT stays
), start AS (
  SELECT list(coalesce(b, 0) ORDER BY s) AS loads
  FROM (SELECT unnest(range({SHARDS})) AS s) LEFT JOIN (SELECT shard, sum(bytes)::BIGINT AS b FROM k WHERE stays GROUP BY 1) ON s = shard
), walk AS (
  SELECT 0::BIGINT AS step, loads, -1::BIGINT AS virtual_slot, -1::BIGINT AS shard FROM start
  UNION ALL
  SELECT n.step, list_transform(w.loads, lambda x, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN x + n.bytes ELSE x END),
    n.virtual_slot, list_position(w.loads, list_min(w.loads)) - 1
  FROM walk w JOIN moving n ON n.step = w.step + 1
), f AS (
  SELECT virtual_slot, shard FROM k WHERE stays UNION ALL SELECT virtual_slot, shard FROM walk WHERE step > 0
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, f.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY f.shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard, virtual_slot::INTEGER AS virtual_slot
FROM r JOIN f USING (virtual_slot)
"""
