"""Runs registered queries against their check SQL and compares rows, order-insensitively."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(spark_df, con, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    names = sorted(spark_df.columns)
    ours = [tuple(_norm(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}"
    pos = [cols.index(n) for n in names]
    theirs = [tuple(_norm(r[p]) for p in pos) for r in cur.fetchall()]
    a, b = sorted(map(repr, ours)), sorted(map(repr, theirs))
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} vs {len(b)} rows; ours only: {only_a[:2]}; theirs only: {only_b[:2]}"


def main(sf_dir: str, wanted: list[str]) -> None:
    from huntframe.plans.oracles import ORACLES
    from huntframe.plans.queries import QUERIES
    from huntframe.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in wanted or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                result = compare(df, con, ORACLES[name]) or "ok"
            else:
                result = f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            result = f"FAIL {str(error)[:400]}".replace("\n", " ")
        print(f"@ {name}: {result} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
