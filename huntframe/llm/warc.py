"""Deterministic sharded WARC archives.

Writer: records are range-sorted by page id and payload digest and dealt to shards by bounds taken from the rows with the
smallest key hashes, so that neither partitioning nor retries change what a shard holds. A task streams its sorted shards,
regenerates every header and digest from the payload, gives each record a gzip member of its own, and rolls to the next file once
the compressed size passes a limit. Files are written under names of their own for each attempt. Their manifest rows are
committed by Spark, then the files that the manifest lists are renamed, and the final manifest makes them visible; files of lost attempts are
never listed. A failed commit can be repeated.

Of records with equal payloads of ``REVISIT_BYTES`` bytes or more, those of the largest page id are responses and the others revisits that
refer to it. Decisions travel as narrow rows and meet their pages in the sorted stream, so that pages are shuffled once and
a payload that many pages share is dealt over many tasks.

Nulls: null html is an empty payload, a null url has no target header, a null page id is kept as such, sorts first and is never
referred to. Repeated rows become records of their own with running numbers. Page ids are assumed to be near unique: rows of one id and
payload share a shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm.storage import shared_path, written

SHARDS = 48
ROLL_BYTES = 64 << 20
REVISIT_BYTES = 1000
SAMPLED_PER_SHARD = 64
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"

_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("file", pa.int32()), ("temporary", pa.string()), ("name", pa.string())]
    + [("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]
)
_MANIFEST_SQL = "shard int, file int, temporary string, name string, bytes long, records long, sha256 string"


def _files(base: str):
    """File system and path of a folder, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{copy}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None) -> bytes:
    """One record before compression: a response with its payload, or a revisit with the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}"]
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest, 0)}")
    head.append(f"WARC-Payload-Digest: sha1:{_base32(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{_base32(block)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_record(data: bytes) -> dict:
    """Headers and payload of one decompressed record; digests are computed anew and must equal the headers'."""
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != END:
        raise ValueError("not a record")
    if headers["WARC-Type"] == "warcinfo":
        return {"type": "warcinfo"}
    if headers["WARC-Block-Digest"] != f"sha1:{_base32(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(END)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (_base32(payload) != named or len(payload) != size):
        raise ValueError("payload digest differs")
    page = lambda name: int(p) if (p := headers[name].split(":")[2]) else None
    return {
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(named).hex(),
        "record_type": kind,
        "refers_to": page("WARC-Refers-To") if kind == "revisit" else None,
        "type": kind,
        "payload": payload,
    }


class Roller:
    """Writes records of one shard after another to files that roll by compressed size; closed files become manifest rows."""

    def __init__(self, base: str, limit: int):
        self.fs, self.path = _files(base)
        self.limit, self.attempt, self.out, self.done = limit, uuid.uuid4().hex, None, []
        self.shard, self.file = None, 0

    def write(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.file = shard, 0
        if self.out is None:
            self.name = f"part-{shard:05d}-{self.file:05d}.warc.gz"
            self.temporary = f"temporary/{self.attempt}-{self.name}"
            self.fs.create_dir(f"{self.path}/temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
            info = f"software: huntframe\r\nformat: WARC File Format 1.1\r\nname: {self.name}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {DATE}\r\n"
            self._put(head.encode() + f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}".encode() + END + info + END)
        self._put(record)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time stamp: equal records, equal bytes
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append((self.shard, self.file, self.temporary, self.name, self.bytes, self.records, self.sha.hexdigest()))
            self.file += 1

    def taken(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, row, strict=True)) for row in done], schema=_MANIFEST)


def _shard_bounds(keys: DataFrame, shards: int) -> list[tuple[int, str]]:
    """Bounds that depend on the rows alone: quantiles of those with the smallest hashes, a fixed number of rows."""
    mark = F.xxhash64("page", "digest")
    some = keys.select("page", "digest", mark.alias("h")).orderBy("h", "page", "digest").limit(SAMPLED_PER_SHARD * shards)
    found = sorted((r.page, r.digest) for r in some.collect())
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def write_archives(pages: DataFrame, base: str, shards: int = SHARDS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``page_id, url, html`` rows below ``base`` and returns the manifest, one row per archive file."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest")
    ).withColumn("page", F.coalesce("page_id", lowest))
    keys = written(rows.select("page", "page_id", "digest", F.length("payload").alias("size")), "page-keys")
    large = keys.filter(F.col("size") >= REVISIT_BYTES)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("owner").isNotNull())
    groups = groups.select("digest", "owner", F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(groups, ["digest", "salt"]).filter(F.col("page") != F.col("owner"))
    bounds = _shard_bounds(keys, shards)
    key = F.struct("page", "digest")
    edges = F.array([F.struct(F.lit(p).cast("long").alias("page"), F.lit(d).alias("digest")) for p, d in bounds]) if bounds else None
    shard = F.size(F.filter(edges, lambda b: b <= key)) if bounds else F.lit(0)
    none = F.lit(None)
    stream = rows.select("page", "digest", F.lit(1).alias("kind"), "page_id", "url", "payload", none.cast("long").alias("owner")).unionByName(
        revisits.select("page", "digest", F.lit(0).alias("kind"), "page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "owner").distinct()
    )
    dealt = stream.withColumn("shard", shard).repartitionByRange(shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", "page", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(base, roll_bytes)
        decided, owner, copy = None, None, 0
        last = None
        for batch in batches:
            for at in range(batch.num_rows):
                shard, page, digest, kind, page_id, url, payload, to = (
                    batch.column(name)[at].as_py() for name in ("shard", "page", "digest", "kind", "page_id", "url", "payload", "owner")
                )
                if kind == 0:
                    decided, owner = (page, digest), to
                    continue
                copy = copy + 1 if last == (page, digest) else 0
                last = (page, digest)
                roller.write(shard, make_record(page_id, url, payload, digest, copy, owner if decided == last else None))
            yield roller.taken()
        roller.close()
        yield roller.taken()

    columns = ["shard", "page", "digest", "kind", "page_id", "url", "payload", "owner"]
    pending = written(dealt.select(*columns).mapInArrow(write, _MANIFEST_SQL), "warc-pending")
    return commit(spark, base, pending)


def commit(spark: SparkSession, base: str, pending: DataFrame) -> DataFrame:
    """Renames the listed files and writes the manifest. Done again after a failure, it goes on where it stopped."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        fs, path = _files(base)
        for batch in batches:
            for row in batch.to_pylist():
                source, to = f"{path}/{row['temporary']}", f"{path}/{row['name']}"
                if fs.get_file_info(source).type != files.FileType.NotFound:
                    fs.move(source, to)
                elif fs.get_file_info(to).size != row["bytes"]:
                    raise FileNotFoundError(to)
            yield batch

    pending.mapInArrow(rename, _MANIFEST_SQL).drop("temporary").write.mode("overwrite").parquet(f"{base}/manifest")
    return spark.read.parquet(f"{base}/manifest")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    data, unpack, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack = None
    if unpack is not None:
        raise EOFError("an archive ends within a record")


class _Digested:
    """A stream that keeps the digest of what was read."""

    def __init__(self, stream):
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


def read_archives(spark: SparkSession, base: str, payloads: bool = False) -> DataFrame:
    """Records of all files the manifest lists; a file that differs from its manifest row fails the read."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _files(base)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{path}/{row['name']}", compression=None) as raw:
                    stream, found, total, held = _Digested(raw), [], 0, 0
                    for member in members(stream):
                        record = parse_record(member)
                        if record["type"] != "warcinfo":
                            found.append({n: record[n] for n in names})
                            total, held = total + 1, held + len(member) * payloads + 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found, held = [], 0
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                if stream.sha.hexdigest() != row["sha256"] or total != row["records"]:
                    raise ValueError(f"{row['name']} differs from its manifest row")

    manifest = spark.read.parquet(f"{base}/manifest")
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(files, "name").mapInArrow(read, columns)


def op1_warc_archives(spark, sf_dir: str) -> DataFrame:
    base = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), base)
    return read_archives(spark, base)


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND owner IS DISTINCT FROM page_id AND owner IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND owner IS DISTINCT FROM page_id THEN owner END AS refers_to
FROM g
"""
