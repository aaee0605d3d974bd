"""N-gram Jaccard self-join by grouped prefixes, and its connected components.

A document's set holds its distinct 4-word shingles (64-bit hashes). Two documents link when their sets' Jaccard similarity is 0.85 or more.

1. Equal sets collapse into one class. Shingles are put in one order for all: those whose hash is in the lowest part of the hash range
   first, the rarest ahead, then all others by hash. The part is ``COUNTED`` times the share of a set that is its prefix, so that prefixes
   seldom leave it, and only its shingles are counted, exactly and over all documents.
2. Sets that link share a shingle of their prefixes (the first ``n - ceil(0.85 n) + 1``). A shingle of one document alone meets nothing, so
   only prefixes' repeated shingles are handed on. Classes with one such prefix and size collapse into a
   group. Only groups meet in the prefix buckets: a task streams a bucket in the order of sizes and yields a star of size-compatible
   groups, not all pairs. The stars' components are clusters: links cannot leave them.
3. Clusters are expanded to their member classes, whose whole sets are verified exactly. A cluster above ``BLOCK_SHINGLES`` is cut into
   parts by size band and hash, and each pair of parts of one band or of neighbours is a block of its own, so that every pair of members
   whose sizes allow a link is verified once. Links are counted where they are found, weighted by the classes' copies; of the links
   themselves a block hands on those that connect what is connected.

Memory: a task holds two parts. Null and empty texts have empty sets and link with nothing. Repeated rows share a class. A null
document id counts as larger than all others.
An empty table gives an empty one. A text of any length is one set of one task. Other columns are not read; an output that is named like the
key gets a ``_`` at its end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm.arrow_text import beside, slices
from huntframe.llm.components import components
from huntframe.llm.storage import delete, written, written_at
from huntframe.llm.word_hashes import BETWEEN_BLANKS, grams, words_of

WORDS = 4
PERCENT = 85
COUNTED = 2
REMEMBERED = 1 << 18
BLOCK_SHINGLES = 1 << 21


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for first, last, data, starts in slices(column):
        hashes, rows = words_of(data, starts, BETWEEN_BLANKS)
        made, _ = grams(hashes, rows, words)
        begin = np.searchsorted(rows, np.arange(last - first + 1))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(made[a : b - words + 1])
            elif b > a:
                yield grams(hashes[a:b], rows[a:b], b - a)[0]
            else:
                yield np.zeros(0, np.uint64)


def _sets(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``key, digest, n, same, spare, low, rest`` per row: ``same`` names the set, ``low`` holds its counted shingles, ``spare`` how many
    of them the prefix does not need, and ``rest`` those of the prefix that are not counted.

    A task gives a repeated set's shingles once, as long as it remembers the set: its last ``REMEMBERED`` ones. The first row of a set
    in a task always has them.
    """
    limit = np.uint64(min(int(COUNTED * (100 - percent)), 100) * ((1 << 64) - 1) // 100)

    def make(batches):
        seen = set()
        for batch in batches:
            names, sizes, spare, low, rest = [], [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                name = hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()
                prefix = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                known = int(np.searchsorted(s, limit, side="right"))
                again = name in seen
                if not again:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                names.append(name)
                sizes.append(len(s))
                spare.append(known - prefix)
                low.append(s[: 0 if again else known].view(np.int64))
                rest.append(s[known : known if again else max(known, prefix)].view(np.int64))
            columns = [pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(spare, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (low, rest))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["key", "digest", "n", "same", "spare", "low", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), _digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(make, f"key {kind}, digest string, n long, same string, spare long, low array<long>, rest array<long>")


def _prefixes(made: DataFrame, classes: DataFrame) -> DataFrame:
    """``row, n, prefix`` of the classes whose prefix holds shingles that other documents may hold, those shingles sorted."""
    counted = made.select("row", F.explode("low").alias("shingle"))
    often, path = written_at(counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "repeated-shingles")
    leaders = classes.select(F.col("cls").alias("row"), "n", "spare")
    hits = counted.join(often, "shingle").join(leaders, "row")
    # counted from the most frequent one, so that shingles of one document need no row
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("f"), F.desc("shingle")))
    held = hits.withColumn("place", place).filter("place > spare").select("row", "n", "shingle")
    others = made.filter(F.size("rest") > 0).join(classes.select(F.col("cls").alias("row")), "row").select("row", "n", F.explode("rest").alias("shingle"))
    prefixes = held.unionByName(others).groupBy("row").agg(F.min("n").alias("n"), F.sort_array(F.collect_list("shingle")).alias("prefix"))
    made_prefixes = written(prefixes, "prefixes")
    delete(made.sparkSession, path)
    return made_prefixes


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: in each bucket every group is tied to the last pivot, a smaller group of compatible size."""

    def run(batches):
        shingle = pivot = before = None
        for batch in batches:
            a, b = [], []
            for s, n, g in zip(*(batch.column(i).to_numpy().tolist() for i in range(3)), strict=True):
                if s != shingle:
                    shingle, pivot, before = s, (n, g), (n, g)
                    continue
                if percent * n <= 100 * pivot[0]:
                    a.append(pivot[1])
                    b.append(g)
                else:
                    if percent * n <= 100 * before[0]:
                        a.append(before[1])
                        b.append(g)
                    pivot = (n, g)
                before = (n, g)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = buckets.select("shingle", "n", "gid").repartition("shingle").sortWithinPartitions("shingle", "n", "gid")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def links_of(ids: list[int], sets: list[np.ndarray], sides: list[int], copies: list[int], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what is connected, and per set the copies of all sets it links to.

    Sets of side 0 are compared with those of side 1, sets of side 2 with one another. Shingles that many sets hold are counted by a
    matrix product, the others by their lists.
    """
    m, side = len(ids), np.array(sides)
    sizes, weights = np.array([len(s) for s in sets]), np.array(copies, np.float64)
    rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    counts, found = np.zeros(m), []
    if not len(rows) or not len(columns):
        return found, counts
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    code, many = code.astype(np.int32), np.bincount(code)
    often = many > max(8, m // 8)
    place = np.cumsum(often) - 1
    dense = np.zeros((m, int(often.sum())), np.float32)
    at = often[code]
    dense[owner[at], place[code[at]]] = 1
    others = np.ascontiguousarray(dense[columns].T)
    owner, code = owner[~at], code[~at]
    begin = np.searchsorted(owner, np.arange(m + 1))
    listed = owner[np.argsort(code, kind="stable")]
    lengths = np.bincount(code, minlength=len(values))
    ends = np.cumsum(lengths)
    label = np.arange(m)
    step = max(1, (1 << 20) // len(columns))
    for first in range(0, len(rows), step):
        some = rows[first : first + step]
        common = (dense[some] @ others).astype(np.int64)
        for k, i in enumerate(some.tolist()):
            mine = code[begin[i] : begin[i + 1]]
            length = lengths[mine]
            if length.sum() > len(mine):  # else no other set holds any of them
                places = np.repeat(ends[mine] - np.cumsum(length), length) + np.arange(length.sum())
                common[k] += np.bincount(listed[places], minlength=m)[columns]
            elif side[i] == 2:
                common[k, i] += len(mine)
        near = (100 + percent) * common >= percent * (sizes[some][:, None] + sizes[columns])
        near &= some[:, None] != columns
        counts[some] += near @ weights[columns]
        if side[some[0]] == 0:
            counts[columns] += weights[some] @ near
        for k, i in enumerate(some.tolist()):
            apart = columns[near[k]]
            apart = apart[label[apart] != label[i]]
            if len(apart):
                joined, heads = np.unique(label[apart], return_index=True)
                found += [(ids[i], ids[j]) for j in apart[heads].tolist()]
                label[np.isin(label, joined)] = label[i]
    return found, counts


def _verified(members: DataFrame, percent: int, words: int) -> DataFrame:
    """``a, b, n`` of the links within each ``block`` of ``block, side, cls, copies, packed`` rows; a task holds one block's sets at a time.

    Rows of two classes connect what is connected; a row of one class counts the documents it links to in the block.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        block, held = None, []

        def closed():
            links, counted = [], []
            if len(held) > 1:
                ids, side, copies, sets = map(list, zip(*held, strict=True))
                links, counts = links_of(ids, sets, side, copies, percent)
                counted = [(x, int(n)) for x, n in zip(ids, counts.tolist(), strict=True) if n]
            a, b = [x for x, _ in links] + [x for x, _ in counted], [y for _, y in links] + [x for x, _ in counted]
            n = [0] * len(links) + [k for _, k in counted]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

        for batch in batches:
            texts = pa.array(map(unpack.decompress, batch.column(4).to_pylist()), pa.large_binary()).cast(pa.large_string())
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (key, cls, side, copies), shingles in zip(rows, shingle_sets(texts, words), strict=True):
                if key != block:
                    yield closed()
                    block, held = key, []
                if not held or held[-1][0] != cls:  # a repeated row brings its text again
                    held.append((cls, side, copies, shingles))
        yield closed()

    ordered = members.select("block", "cls", "side", "copies", "packed").repartition("block").sortWithinPartitions("block", "cls")
    return ordered.mapInArrow(run, "a long, b long, n long")


def _fetched(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """The members with their texts, compressed before they are shuffled: a text takes less room than its shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def pack(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["key", "digest", "packed"])

    texts = docs.select(F.col(f"`{key}`").alias("key"), _digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    texts = texts.mapInArrow(pack, f"key {kind}, digest string, packed binary")
    wanted = members.withColumnRenamed("key", "wanted").withColumnRenamed("digest", "wanted_digest")
    found = texts.join(wanted, (texts["digest"] == wanted["wanted_digest"]) & texts["key"].eqNullSafe(wanted["wanted"]))
    return found.drop("key", "digest", "wanted", "wanted_digest")


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """Adds ``band``, ``small``, ``parts`` and ``part``, which block of its cluster a member belongs to, and the neighbour bands' ``before``, ``after``."""
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")  # sets that link are in one band or in neighbours
    rows = members.withColumn("band", band)
    totals = rows.groupBy("cluster", "band").agg(F.sum("n").alias("size"))
    whole = totals.groupBy("cluster").agg(F.sum("size").alias("all"))
    cut = totals.join(whole, "cluster").select(
        "cluster", "band", (F.col("all") <= BLOCK_SHINGLES).alias("small"), F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("parts")
    )
    cut = written(cut, "cluster-bands")
    next_to = lambda by, label: cut.select("cluster", (F.col("band") + by).alias("band"), F.col("parts").alias(label))
    cut = cut.join(next_to(1, "before"), ["cluster", "band"], "left").join(next_to(-1, "after"), ["cluster", "band"], "left")
    return rows.join(cut, ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))


def _tiles(rows: DataFrame) -> DataFrame:
    """The placed members by ``block``, the pair of parts that is verified there, and their ``side`` of it; each pair of members meets once."""
    tile = lambda a, i, b, j: F.concat_ws(":", "cluster", a, i, b, j)
    row = lambda block, side: F.struct(block.alias("block"), side.cast("int").alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    band, part = F.col("band"), F.col("part")
    own = F.transform(
        upto("parts"), lambda q: row(tile(band, F.least(part, q), band, F.greatest(part, q)), F.when(part == q, 2).when(part < q, 0).otherwise(1))
    )
    after = F.transform(upto("after"), lambda q: row(tile(band, part, band + 1, q), F.lit(0)))
    before = F.transform(upto("before"), lambda q: row(tile(band - 1, q, band, part), F.lit(1)))
    all_ = F.when(F.col("small"), F.array(row(F.col("cluster").cast("string"), F.lit(2)))).otherwise(F.concat(own, after, before))
    return rows.withColumn("tile", F.explode(all_)).select("tile.block", "tile.side", "cls", "copies", "packed")


def joined_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """``key, n_shingles, component_id, n_links, digest``: per row its set's size, the smallest key it reaches by links, and how many other
    rows it links to."""
    spark = docs.sparkSession
    sets, path = written_at(_sets(docs, key, text, words, percent).withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    made = written(sets.drop("low", "rest"), "documents")
    classes = made.filter("n > 0").groupBy("same")
    classes = classes.agg(F.min("row").alias("cls"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("spare").alias("spare"))
    classes = written(classes, "classes")
    prefixes = _prefixes(sets, classes)
    delete(spark, path)
    named = prefixes.withColumn("p", F.xxhash64(F.lit(1), "prefix")).withColumn("q", F.xxhash64(F.lit(2), "prefix"))
    groups = named.groupBy("n", "p", "q").agg(F.min("row").alias("gid"), F.count(F.lit(1)).alias("members"))
    grouped = named.drop("prefix").join(groups, ["n", "p", "q"]).select("row", "gid", "members")
    rows = made.select("row", "key", "digest", "n").join(grouped, "row").join(classes.select(F.col("cls").alias("row"), "copies"), "row")
    members = written(rows.withColumnRenamed("row", "cls"), "group-members")
    leaders = members.filter("gid = cls").select(F.col("gid").alias("row"))
    buckets = prefixes.join(leaders, "row").select(F.explode("prefix").alias("shingle"), "n", F.col("row").alias("gid"))
    clusters = components(_stars(buckets, percent), "clusters").withColumnRenamed("node", "gid")
    expanded = members.join(clusters, "gid", "left").filter("label is not null or members > 1")
    expanded = expanded.withColumn("cluster", F.coalesce("label", "gid"))
    narrow = written(_placed(expanded.select("cluster", "cls", "copies", "key", "digest", "n"), percent), "cluster-members")
    rows, path = written_at(_fetched(docs, narrow, key, text), "cluster-texts")
    links = written(_verified(_tiles(rows), percent, words), "links")
    delete(spark, path)
    linked = components(links, "linked").withColumnRenamed("node", "cls")
    counts = links.filter("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    named = classes.drop("n", "spare").join(linked, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    named = named.join(least, "label").join(counts, "cls", "left").select("same", "component_id", n_links.alias("n_links"))
    out = made.join(named, "same", "left")
    size, component, n_links, digest = beside(key, "n_shingles", "component_id", "n_links", "digest")
    return out.select(
        F.col("key").alias(key), F.col("n").alias(size), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias(component),
        F.coalesce("n_links", F.lit(0)).alias(n_links), F.col("digest").alias(digest),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that lead their component, with their own columns: of each group of linked documents that of the smallest key.

    Rows of texts without words link with nothing and stay. Rows that repeat key and text are one document: one of them stays.
    """
    judged = joined_documents(docs, key, text, words, percent)
    own, _, component, _, digest = (F.col(f"`{name}`") for name in judged.columns)
    lead = judged.filter(own.eqNullSafe(component)).select(own.alias("_lead"), digest.alias("_same")).distinct()
    lead = written(lead, "leaders")
    name = "_text_digest"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, _digest(text))
    kept = marked.join(lead, (marked[name] == lead["_same"]) & marked[f"`{key}`"].eqNullSafe(lead["_lead"]), "left_semi")
    return kept.dropDuplicates([key, name]).select(*docs.columns)


def op8_grouped_prefix_join(spark, sf_dir: str) -> DataFrame:
    return joined_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")
