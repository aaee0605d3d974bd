"""Phrase collocations per language by marginalising the longest windows.

Every word starts one window: itself and the words after it in its piece, ``LONGEST`` at most, padded with empty words. Only these windows
are counted. A phrase occurs as often as windows start with it, so one Spark ROLLUP over (lang, first word, ..., last word) yields the
counts of all shorter phrases as sums of longer ones, down to the number of words of a language.

A phrase that occurs ``least`` times holds only parts that do. Before windows are counted, the words, then pairs, then triples that are too rare are
found with counters of a fixed number of slots (by hash), and windows end before the first rare part. A slot's count is never less than that of a part in
it, so no phrase that counts is cut; two parts in one slot only make a window longer than needed. What is broadcast is one bit per
slot, ``SLOTS`` of them per size, whatever the corpus. All counts are of words themselves, not of hashes.

A task adds up equal windows before it hands them on. A phrase that counts is in nearly every task, so rows are handed on as often as there are
tasks; windows are therefore counted by ``ROUNDS`` tasks a core, each of several splits of the input, not by one task a split.

Null texts are empty, empty texts and tables have no phrases, null languages count as ``und``. Repeated rows count each. Texts of any length are
cut into words whole; a task holds about ``SLICE`` bytes of texts at a time, or one longer text. Only the two named columns are read, so others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntframe.llm import storage
from huntframe.llm.arrow_text import slices
from huntframe.llm.word_hashes import FOLD, U64, mixed, powers

LONGEST = 5
LEAST = 100
TOP = 2000
#: Sizes of parts, from one word on, whose rare ones end a window, and the counters (powers of two) for each.
SLOTS = {1: 1 << 24, 2: 1 << 26, 3: 1 << 26}
SEGMENT = 1 << 15
SLICE = 8 << 20
#: A task adds up so many windows before it hands them on.
HELD = 1_000_000
#: Tasks a core that count windows, at most.
ROUNDS = 2
#: Each language's phrases are ranked in so many groups first.
SALTS = 64

_ENDS = np.zeros(256, bool)
_ENDS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_BLANK = _ENDS.copy()
_BLANK[[32, 9]] = True
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


class Words:
    """The words of some texts: each one's number in the list of different words, and where pieces end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        data = FOLD[data]
        inside = np.zeros(len(data) + 1, bool)
        np.logical_not(_BLANK[data], out=inside[:-1])
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2] | edge[1:-1]
        last = inside[:-1] & (~inside[1:] | edge[1:])
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[inside[:-1]])).dictionary_encode()
        self.ids = words.indices.to_numpy()
        self.different: pa.LargeStringArray = words.dictionary
        breaks = np.flatnonzero(_ENDS[data] | edge[:-1])  # a word after a break starts a new piece
        piece = np.searchsorted(breaks, begin, "right")
        self.joined = piece[1:] == piece[:-1]

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of the language and each different word."""
        offsets = np.frombuffer(self.different.buffers()[1], np.int64)[: len(self.different) + 1]
        data = np.frombuffer(self.different.buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(U64) + U64(1)
        place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(data * powers(int(place.max(initial=0)) + 1)[place], out=sums[1:])
        seed = U64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") ^ (len(lang) << 56))
        return mixed(mixed(sums[offsets[1:]] - sums[offsets[:-1]]) + seed)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & U64(slots - 1)).astype(np.int64)


def _levels(words: Words, lang: str, frequent: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size whether the words from each word on are one piece without a part known to be rare, and the hash of up to one word more than known."""
    each = words.hashes(lang)
    alive, hashes = np.ones(len(words.ids), bool), each[words.ids]
    for size in range(1, longest + 1):
        if size > 1:
            alive = alive[:-1] & alive[1:] & words.joined[: max(len(alive) - 1, 0)]
        if 1 < size <= len(frequent) + 1:
            kept = np.flatnonzero(alive)
            longer = np.zeros(len(alive), U64)
            longer[kept] = mixed(hashes[kept] * U64(0xD6E8FEB86659FD93) + each[words.ids[kept + size - 1]])
            hashes = longer
        if size in frequent:
            kept = np.flatnonzero(alive)
            slot = _slot(hashes[kept], len(frequent[size]) * 8)
            alive[kept] = (frequent[size][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        yield size, alive, hashes


def _by_language(batches) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for lang in langs.unique().to_pylist():
            for _, _, data, starts in slices(texts.filter(pa.compute.equal(langs, lang)), SLICE):
                yield lang, Words(data, starts)


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.col(f"`{text}`"))


def _frequent_slots(read: DataFrame, size: int, slots: int, known: Broadcast, least: int) -> np.ndarray:
    """Bits of the slots in which the parts of ``size`` words are counted ``least`` times or more."""

    def counted(batches):
        for lang, words in _by_language(batches):
            *_, (_, alive, hashes) = _levels(words, lang, known.value, size)
            used, n = np.unique(_slot(hashes[alive], slots), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    def packed(batches):
        for batch in batches:
            rows = []
            for at in batch.column(1).to_pylist():
                bits = np.zeros(SEGMENT, np.uint8)
                bits[at] = 1
                rows.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["segment", "bits"])

    many = read.mapInArrow(counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    segments = many.groupBy((F.col("slot") / SEGMENT).cast("int").alias("segment")).agg(F.collect_list(F.col("slot") % SEGMENT).alias("at"))
    bits = np.zeros(max(slots, SEGMENT) // 8, np.uint8)  # one row for each SEGMENT of the slots
    for row in segments.mapInArrow(packed, "segment int, bits binary").toLocalIterator():
        bits[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def windows(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", slots: dict[int, int] | None = None) -> DataFrame:
    """``lang, w1, ..., n``: how often each padded window occurs. Words that can't be in a phrase count as windows of no word."""
    read, context = _read(docs, text, lang), docs.sparkSession.sparkContext
    frequent: dict[int, np.ndarray] = {}
    known = context.broadcast(frequent)
    for size, number in (slots or SLOTS).items():
        frequent = {**frequent, size: _frequent_slots(read, size, number, known, least)[: number // 8]}
        known.unpersist()
        known = context.broadcast(frequent)

    return _task_windows(read, known).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))


def _task_windows(read: DataFrame, known: Broadcast) -> DataFrame:
    """``lang, w1, ..., n``: the padded windows of each task, added up as far as ``HELD`` allows."""

    def counted(batches):
        parts, rows = [], 0
        for name, words in _by_language(batches):
            parts.append(_padded(name, words, known.value))
            rows += len(parts[-1])
            if rows > HELD:
                parts, rows = [_summed(parts)], 0
                if len(parts[0]) > HELD // 2:
                    yield from parts.pop().to_batches()
        if parts:
            yield from _summed(parts).to_batches()

    schema = ", ".join(f"{c} string" for c in ("lang", *WORDS))
    tasks = ROUNDS * read.sparkSession.sparkContext.defaultParallelism
    return read.coalesce(tasks).mapInArrow(counted, f"{schema}, n long")


def _padded(lang: str, words: Words, frequent: dict[int, np.ndarray]) -> pa.Table:
    """The padded windows of some words and how often each occurs."""
    reach = np.zeros(len(words.ids), np.int64)  # how many words each window has
    for size, alive, _ in _levels(words, lang, frequent, LONGEST):
        reach[np.flatnonzero(alive)] = size
    pad = len(words.different)
    ids = np.append(words.ids, np.full(LONGEST, pad, words.ids.dtype))
    at = np.flatnonzero(reach)
    columns = {w: np.where(reach[at] > i, ids[at + i], pad).astype(np.int32) for i, w in enumerate(WORDS)}
    rows = pa.table(columns).group_by(WORDS).aggregate([([], "count_all")])
    names = pa.concat_arrays([words.different.cast(pa.string()), pa.array([""])])
    rest = len(words.ids) - len(at)
    blank = pa.array([""] * bool(rest), pa.string())
    made = [pa.concat_arrays([names.take(rows.column(w).combine_chunks()), blank]) for w in WORDS]
    n = pa.concat_arrays([rows.column("count_all").combine_chunks(), pa.array([rest] * bool(rest), pa.int64())])
    return pa.table([pa.array([lang] * len(n), pa.string()), *made, n], names=["lang", *WORDS, "n"])


def _summed(parts: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(parts).group_by(["lang", *WORDS]).aggregate([("n", "sum")])
    return added.select(["lang", *WORDS, "n_sum"]).rename_columns(["lang", *WORDS, "n"])


def phrase_counts(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, size, words, n``: the total of each language (size 0) and each phrase of up to ``LONGEST`` words that occurs ``least`` times."""
    keys = ["lang", *WORDS]
    rolled = counted.rollup(*keys).agg(F.sum("n").alias("n"), F.grouping_id(*keys).alias("rolled"))
    # the low bits of the id stand for the words summed over: size k leaves out the last LONGEST - k
    size = F.element_at(
        F.create_map(*[F.lit(x) for k in range(LONGEST + 1) for x in ((1 << (LONGEST - k)) - 1, k)]), F.col("rolled").cast("int")
    )
    sized = rolled.filter(F.col("rolled") < 1 << LONGEST).withColumn("size", size)
    whole = (F.col("size") == 0) | (F.array(*WORDS)[F.greatest(F.col("size") - 1, F.lit(0))] != "")
    phrases = sized.filter(whole & ((F.col("n") >= least) | (F.col("size") == 0)))
    return phrases.select("lang", "size", F.slice(F.array(*WORDS), 1, F.col("size")).alias("words"), "n")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", slots: dict[int, int] | None = None
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases by the score of their weakest cut."""
    counts = storage.written(phrase_counts(windows(docs, least, text, lang, slots), least), "phrases")
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    parts = counts.filter(F.col("size") > 0).select("lang", "size", "words", F.array_join("words", " ").alias("phrase"), "n")
    candidates = parts.filter("size > 1")
    # a phrase inside a longer one of the same count stands in one longer by one word, too
    inner = candidates.filter("size > 2").select(
        "lang", F.explode(F.array(*[F.array_join(F.slice(F.col("words"), i, F.col("size") - 1), " ") for i in (1, 2)])).alias("phrase"), F.col("n").alias("longer")
    )
    none = F.lit(None).cast("long")
    closed = (
        candidates.select("lang", "phrase", "words", "size", F.col("n").alias("a"), none.alias("longer"))
        .unionByName(inner.select("lang", "phrase", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("int").alias("size"), none.alias("a"), "longer"))
        .groupBy("lang", "phrase").agg(F.first("words", True).alias("words"), F.max("size").alias("size"), F.max("a").alias("a"), F.max("longer").alias("longer"))
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100))
    )
    cuts = closed.select("lang", "phrase", "words", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first_part"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("last_part"),
    )
    shorter = parts.filter(F.col("size") < LONGEST).select("lang", "phrase", "n")
    scored = (
        cuts.join(shorter.select("lang", F.col("phrase").alias("first_part"), F.col("n").alias("l")), ["lang", "first_part"])
        .join(shorter.select("lang", F.col("phrase").alias("last_part"), F.col("n").alias("r")), ["lang", "last_part"])
        .join(totals, "lang")
        .withColumn("score", F.expr("(cast(1000 * a as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("w"))
    flat = weakest.select("lang", "phrase", "w.a", "w.l", "w.r", F.col("w.total").alias("n"), "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, phrase, n AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), inner_ones AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates))
), kept AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 100 * c.a)
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r, totals.n AS n,
    ((1000 * c.a::HUGEINT * totals.n::HUGEINT) // (h.n::HUGEINT * t.n::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals ON totals.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest
)
SELECT * FROM ranked WHERE rank <= 2000
"""
