from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from huntframe.llm import warc
from huntframe.llm.storage import shared_path

LONG, OTHER = "é" * 600, "y" * 1500
ROWS = (
    [(i, f"http://h/{i}", LONG) for i in (5, 3, 9)] + [(4, "http://h/4", LONG)] * 2 + [(None, "http://n", LONG), (7, None, OTHER), (8, "a\r\nb", OTHER)]
    + [(1, "u", None), (2, "u", ""), (10, "u", "short"), (11, "u", "short"), (12, "u", "z" * 400000), (None, "u", "q" * 1200), (None, "v", "q" * 1200)]
    + [(100 + i, f"http://w/{i}", f"<p>{i}</p>" * 300) for i in range(80)]
)


def expected():
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        owner = max(same) if same and len(data) >= 1000 else None
        revisit = owner is not None and page != owner
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


def written_files(spark, df, **options):
    base = shared_path(spark, "warc-test")
    warc.write_archives(df, base, **options)
    return base


def test_round_trip_rolls_and_is_deterministic(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, shard int")
    one = written_files(spark, df.repartition(3), shards=4, roll_bytes=2000)
    two = written_files(spark, df.repartition(5), shards=4, roll_bytes=2000)
    assert sorted(map(tuple, warc.read_archives(spark, one).collect()), key=repr) == expected()
    files = lambda base: {p.name: p.read_bytes() for p in Path(base.removeprefix("file://")).glob("*.warc.gz")}
    assert len(files(one)) > 8 and files(one) == files(two)
    payloads = {r.page_id: r.payload for r in warc.read_archives(spark, one, payloads=True).collect() if r.record_type == "response"}
    assert payloads[9].decode() == LONG and payloads[12] == b"z" * 400000


def test_only_listed_files_count_and_damage_is_seen(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    base = written_files(spark, df, shards=2)
    folder = Path(base.removeprefix("file://"))
    (folder / "temporary" / "lost-part.warc.gz").write_bytes(b"half a file")
    (folder / "part-09999-00000.warc.gz").write_bytes(b"not listed")
    assert warc.read_archives(spark, base).count() == len(ROWS)
    name = next(p for p in folder.glob("part-0000[01]-*.warc.gz"))
    name.write_bytes(name.read_bytes()[:-7])
    with pytest.raises(Exception, match="ends within a record|differs|archive"):
        warc.read_archives(spark, base).count()


def test_a_commit_can_be_repeated(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    base = written_files(spark, df, shards=3)
    pending = spark.read.parquet(f"{base}/manifest").selectExpr("shard", "file", "'temporary/gone' temporary", "name", "bytes", "records", "sha256")
    rows = spark.createDataFrame(pending.collect(), pending.schema)
    assert warc.commit(spark, base, rows).count() == rows.count()


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, written_files(spark, df)).count() == 0
