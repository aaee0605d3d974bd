"""Removal of repeated bytes by suffix ordering: each byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere.

How the work is dealt out. Every string of ``LENGTH`` bytes holds an anchor: of its grams of ``GRAM`` bytes the one of smallest hash, the
first among equals. Equal strings have equal anchors at equal places, so only strings around equal anchors need comparing. A task
finds a document's anchors and, for each, the context: the bytes of all the strings that chose it. Anchors travel as two hashes, of the gram
and of the context. Equal contexts of one text travel as one row with all their places: a run of one byte makes an anchor of every byte.

* An anchor hash that occurs once has no repeats.
* Contexts that occur twice or more repeat as a whole; they are counted, not gathered.
* Where an anchor has several distinct contexts, one of each is fetched. The suffixes that start at the anchors are ordered,
  and in the same way the reversed prefixes that end there: multikey quicksort by words of eight bytes to a shallow depth
  (the gram itself is equal anyway), then a blind trie for each group that is still equal. Neighbours' common prefixes tell how
  far each context agrees with others to the right and to the left; only strings within that reach can repeat, and those are compared by their
  classes in both orders, which is exact.
* An anchor with more than ``GROUP`` distinct contexts is not gathered: the strings that may repeat are hashed (128 bits) and counted.

Results come back as ranges of positions per document, are merged, and cut the text. Null texts count as empty. Matches never
cross documents. Repeated rows are copies of one another. Grams and contexts are told apart by 64 and 128 bit hashes.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.storage import delete_since, mark, written, written_at
from huntframe.llm.word_hashes import U64, mixed, powers

LENGTH = 400
GRAM = 200
#: Distinct contexts of one anchor that a task may gather; more are counted by hash instead.
GROUP = 4096
SHALLOW = 4  # words of eight bytes
BATCH = 20_000  # contexts that a task orders at once
PIECE = 1 << 18  # bytes of a text whose anchors are found at a time
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANGES = pa.schema([("gram", pa.int64()), ("mark", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * powers(len(data) + 1, _INVERSE)[: len(data) - gram + 1])


def _window_minimum(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window its first smallest place: minima over blocks from both sides, ties to the left."""
    n = len(hashes) - width + 1
    padded = -(-len(hashes) // width) * width
    h = np.full(padded, np.iinfo(np.uint64).max, U64)
    h[: len(hashes)] = hashes
    blocks = h.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    place = np.arange(padded).reshape(-1, width)
    # the place of the running minimum: kept unless a smaller value comes (ahead) or one as small (back, towards the left)
    fresh = np.ones_like(blocks, bool)
    fresh[:, 1:] = blocks[:, 1:] < ahead[:, :-1]
    first = np.maximum.accumulate(np.where(fresh, place, -1), axis=1)
    fresh = np.ones_like(blocks, bool)
    fresh[:, :-1] = blocks[:, :-1] <= back[:, 1:]
    last = np.minimum.accumulate(np.where(fresh, place, padded)[:, ::-1], axis=1)[:, ::-1]
    left, right = back.reshape(-1)[:n], ahead.reshape(-1)[width - 1 : width - 1 + n]
    return np.where(left <= right, last.reshape(-1)[:n], first.reshape(-1)[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first and last start of the strings that chose it."""
    parts = []
    for begin in range(0, len(data) - length + 1, PIECE):
        piece = data[begin : begin + PIECE + length - 1]
        hashes = _gram_hashes(piece, gram)
        chosen = _window_minimum(hashes, length - gram + 1)
        edges = np.flatnonzero(np.diff(chosen)) + 1
        first = np.concatenate([[0], edges])
        last = np.concatenate([edges, [len(chosen)]]) - 1
        at = chosen[first]
        parts.append((at + begin, hashes[at], first + begin, last + begin))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---- ordering of suffixes


def _common(a: bytes, b: bytes, start: int) -> int:
    """How many bytes two strings share, at least ``start``."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    low, high = start, end
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _BlindTrie:
    """Orders strings by where they part: an inner node ``[depth, {byte: child}]`` knows nothing of the bytes before its depth.

    A leaf is a tuple of the numbers of equal strings. A string's end counts as the byte -1.
    """

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None

    def _byte(self, text: bytes, at: int) -> int:
        return text[at] if at < len(text) else -1

    def add(self, which: int) -> None:
        if self.root is None:
            self.root = (which,)
            return
        text, node, path = self.texts[which], self.root, []
        while isinstance(node, list):  # blind: any leaf below shares as much as the path says
            path.append(node)
            node = node[1].get(self._byte(text, node[0])) or next(iter(node[1].values()))
        other = self.texts[node[0]]
        shared = _common(text, other, 0)
        above = None
        for inner in path:
            if inner[0] >= shared and not shared == len(text) == len(other):
                break
            above = inner
        below = self.root if above is None else above[1][self._byte(text, above[0])]
        if shared == len(text) == len(other):
            new = (*below, which)
        elif isinstance(below, list) and below[0] == shared:
            below[1][self._byte(text, shared)] = (which,)
            return
        else:
            new = [shared, {self._byte(other, shared): below, self._byte(text, shared): (which,)}]
        if above is None:
            self.root = new
        else:
            above[1][self._byte(text, above[0])] = new

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(texts: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and what each shares with the one before it.

    Multikey quicksort, eight bytes at a time: a group is parted by its middle word into smaller, equal and larger; equal ones go on
    to the next word until the shallow depth, where a blind trie takes over.
    """
    n = len(texts)
    size = shallow * 8
    heads = np.frombuffer(b"".join(t[:size].ljust(size, b"\0") for t in texts), ">u8").reshape(n, shallow).astype(U64) if n else np.zeros((0, shallow), U64)
    order: list[int] = []
    stack = [(np.arange(n), 0)]
    while stack:
        group, word = stack.pop()
        if len(group) == 0:
            continue
        if len(group) == 1:
            order.append(int(group[0]))
        elif word == shallow:
            trie = _BlindTrie(texts)
            for which in group.tolist():
                trie.add(which)
            order += trie.ordered()
        else:
            keys = heads[group, word]
            pivot = keys[len(keys) // 2]
            stack += [(group[keys > pivot], word), (group[keys == pivot], word + 1), (group[keys < pivot], word)]
    shared = np.zeros(n, np.int64)
    for k in range(1, n):
        shared[k] = _common(texts[order[k - 1]], texts[order[k]], 0)
    return np.array(order, np.int64), shared


def repeated_offsets(
    contexts: list[bytes], at: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, length: int
) -> list[list[tuple[int, int]]]:
    """Per context the ranges of starts (relative to the anchor, from and to) of strings that another context of its group has too.

    ``at``: the anchor's place in the context; ``first`` and ``last``: starts, relative to the anchor (none positive).
    """
    n = len(contexts)
    tag = [int(g).to_bytes(8, "big") for g in group]  # keeps groups apart in one order
    right, right_shared = deep_shallow([t + c[a:] for t, c, a in zip(tag, contexts, at.tolist(), strict=True)])
    left, left_shared = deep_shallow([t + c[:a][::-1] for t, c, a in zip(tag, contexts, at.tolist(), strict=True)])
    right_shared, left_shared = np.maximum(right_shared - 8, -1), np.maximum(left_shared - 8, -1)
    reach = []
    for order, shared in ((left, left_shared), (right, right_shared)):
        most = np.full(n, -1)
        if n > 1:
            most[order] = np.maximum(shared, np.append(shared[1:], -1))
            most[order[0]] = shared[1]
        reach.append(most)
    # a string that starts d before the anchor repeats only if d bytes to the left and length - d to the right agree
    low = np.maximum(-last, length - reach[1])
    high = np.minimum(-first, reach[0])
    found: list[list[int]] = [[] for _ in range(n)]
    live = np.flatnonzero(low <= high)
    if len(live):
        rank_left, rank_right = np.empty(n, np.int64), np.empty(n, np.int64)
        rank_left[left], rank_right[right] = np.arange(n), np.arange(n)
        for d in range(int(low[live].min()), int(high[live].max()) + 1):
            now = live[(low[live] <= d) & (d <= high[live])]
            if len(now) < 2:
                continue
            class_left = np.cumsum(left_shared < d)[rank_left[now]]
            class_right = np.cumsum(right_shared < length - d)[rank_right[now]]
            _, code, counts = np.unique(class_left * (n + 1) + class_right, return_inverse=True, return_counts=True)
            for i in now[counts[code] > 1].tolist():
                found[i].append(-d)
    return [_ranges(sorted(x)) for x in found]


def _ranges(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and v == out[-1][1] + 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [(a, b) for a, b in out]


# ---- Spark

_PLACE = ("gram", "mark", "at", "first", "last")
_PLACE_SQL = "gram:bigint,mark:bigint,at:int,first:int,last:int"
_PLACE_ARROW = [("gram", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]
_ALL = "all_at"  # every place in the text of a context; ``at`` is the first of them


def _name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _places(raw: bytes, length: int, gram: int) -> list[tuple]:
    at, hashes, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
    found: dict[tuple, tuple] = {}
    for p, h, a, b in zip(at.tolist(), hashes.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
        mark = hashlib.blake2b(raw[a : b + length] + (p - a).to_bytes(4, "big"), digest_size=8).digest()
        same = found.setdefault((h, mark), (h, int.from_bytes(mark, "big", signed=True), p, a, b, []))
        same[-1].append(p)
    return list(found.values())


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``name, places``: the 128-bit name of each text and its distinct contexts with all their anchors, and hashes of gram and context."""

    def run(batches):
        for batch in batches:
            names, ends, all_ends = [], array("i", [0]), array("i", [0])  # flat columns: a Python object per anchor takes much more memory
            columns, all_at = [array(kind) for kind in "qqiii"], array("i")
            for text in batch.column(0).to_pylist():
                raw = (text or "").encode()
                names.append(_name(raw))
                for *place, ats in _places(raw, length, gram):
                    for column, value in zip(columns, place, strict=True):
                        column.append(value)
                    all_at.extend(ats)
                    all_ends.append(len(all_at))
                ends.append(len(all_ends) - 1)
            flat = [pa.array(np.array(c)) for c in columns] + [pa.ListArray.from_arrays(pa.array(np.array(all_ends)), pa.array(np.array(all_at)))]
            places = pa.ListArray.from_arrays(pa.array(np.array(ends)), pa.StructArray.from_arrays(flat, names=[*_PLACE, _ALL]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), places], names=["name", "places"])

    return docs.select("text").mapInArrow(run, f"name binary, places array<struct<{_PLACE_SQL},{_ALL}:array<int>>>")


def _packed(docs: DataFrame) -> DataFrame:
    """``key, name, packed``: texts compressed before they are shuffled."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(_name, raw), pa.binary()), pa.array(map(pack.compress, raw), pa.binary())], names=["key", "name", "packed"]
            )

    return docs.select("key", "text").mapInArrow(run, f"key {kind}, name binary, packed binary")


def _context_rows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``gram, mark, at, first, last, context`` of the wanted places, each of one text; copies of a text may repeat them."""
    lists = wanted.groupBy("name").agg(F.collect_list(F.struct(*_PLACE)).alias("places"))  # of one text
    found = _packed(docs).select("name", "packed").join(lists, "name").select("packed", "places")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack.decompress(packed)
                columns = [pa.array([p[k] for p in places], t) for k, t in _PLACE_ARROW]
                contexts = pa.array([raw[p["first"] : p["last"] + length] for p in places], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, contexts], names=[*_PLACE, "context"])

    return found.mapInArrow(run, "gram long, mark long, at int, first int, last int, context binary")


def _ordered_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """``gram, mark, from, to``: ranges of starts relative to the anchor, by ordering the contexts of many anchors at once."""

    def done(rows):
        at = np.array([r[2] - r[3] for r in rows], np.int64)
        first = np.array([r[3] - r[2] for r in rows], np.int64)
        last = np.array([r[4] - r[2] for r in rows], np.int64)
        _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        out = []
        for row, ranges in zip(rows, repeated_offsets([r[5] for r in rows], at, first, last, group, length), strict=True):
            out += [(row[0], row[1], a, b) for a, b in ranges]
        return pa.RecordBatch.from_pylist([dict(zip(("gram", "mark", "from", "to"), r, strict=True)) for r in out], schema=_RANGES)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue  # the same context from a copy of the text
                if len(held) >= BATCH and held[-1][0] != row[0]:  # an anchor's contexts stay together: GROUP at most
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    ordered = contexts.select(*_PLACE, "context").repartition("gram").sortWithinPartitions("gram", "mark")
    return ordered.mapInArrow(run, "gram long, mark long, `from` int, `to` int")


def _counted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts to gather: strings are hashed and counted, combined in each task first."""
    schema = pa.schema([("gram", pa.int64()), ("mark", pa.int64()), ("from", pa.int32()), ("string", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for gram, mark, at, first, last, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start in range(first, last + 1):
                    out.append({"gram": gram, "mark": mark, "from": start - at, "string": _name(context[start - first : start - first + length])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    once = contexts.select(*_PLACE, "context").dropDuplicates(["gram", "mark"])
    rows = once.mapInArrow(run, "gram long, mark long, `from` int, string binary")
    again = rows.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    return rows.join(again, "string").select("gram", "mark", "from", F.col("from").alias("to"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``name, spans``: per text that has any, the sorted and merged byte ranges to remove; for ``key, text`` rows."""
    made = written(_anchor_rows(docs, length, gram), "anchors")
    places = made.select("name", F.explode("places").alias("p")).select("name", "p.*")
    # tables of their own: the joins below read plain rows by gram, so Spark can split a gram that many texts share
    often = places.groupBy("gram").agg(F.sum(F.size(_ALL)).alias("n")).filter("n > 1").select("gram")
    live = written(places.join(written(often, "often"), "gram", "left_semi"), "live-anchors")
    contexts = live.groupBy("gram", "mark").agg(F.sum(F.size(_ALL)).alias("n"), F.min(F.struct("name", "at", "first", "last")).alias("p"))
    contexts = written(contexts, "contexts")
    kinds = written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    wanted = contexts.join(kinds, "gram").select("gram", "mark", "p.*", "kinds")
    crowded = written(kinds.filter(F.col("kinds") > GROUP).select("gram"), "crowded")
    bodies = written(_context_rows(docs, wanted, length), "context-bytes")
    few = _ordered_ranges(bodies.join(crowded, "gram", "left_anti"), length)
    many = _counted_ranges(bodies.join(crowded, "gram", "left_semi"), length)
    # contexts that occur more than once repeat as a whole; of the others, what the comparison found
    whole = contexts.filter("n > 1").select("gram", "mark", (F.col("p.first") - F.col("p.at")).alias("from"), (F.col("p.last") - F.col("p.at")).alias("to"))
    parts = few.unionByName(many).join(contexts.filter("n = 1").select("gram", "mark"), ["gram", "mark"], "left_semi")
    ranges = whole.unionByName(parts).groupBy("gram", "mark").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))  # of one context
    hit = live.join(written(ranges, "ranges"), ["gram", "mark"]).select("name", _ALL, F.explode("ranges").alias("r")).select("name", F.explode(_ALL).alias("at"), "r")
    spans = hit.select("name", (F.col("at") + F.col("r.from")).alias("a"), (F.col("at") + F.col("r.to") + length).alias("b")).distinct()
    return spans.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))  # of one text


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bodies: bool = False
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` per row, and with ``bodies`` the bytes that are left as ``kept``."""
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    point = mark()
    spans, path = written_at(repeated_spans(docs, length, gram), "spans")
    delete_since(docs.sparkSession, point, keep=path)
    texts = _packed(docs).join(spans, "name", "left").select("key", "packed", "spans")
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * bodies]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, counts, shas, kept = [], [], [], [], []
            for packed, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, parts = unpack.decompress(packed), 0, []
                ranges = merged([(s["a"], s["b"]) for s in cut or ()])
                for a, b in ranges:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                counts.append(len(ranges))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(shas)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * bodies, names=names)

    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * bodies
    return texts.mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("has_repeats", F.col("n_removed") > 0)
