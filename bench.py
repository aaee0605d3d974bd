"""Times the registered headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query runs once to warm up
and is then timed into a sink that drops its rows. The events are laid out as several part files first, as a table of any size is; one
file of one row group would leave each scan to one core.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from huntframe.plans.queries import QUERIES
from huntframe.session import clean_scratch, local_session, scratch_path

HEADLINE = (
    "normalize_route", "xml_events", "message_fields", "native_rule_matches", "sigma_like_matches", "alert_documents",
    "realtime_rules", "candidate_topk", "sequence_process_network_file", "sequence_with_optional", "host_ordinals",
    "correlate_batch", "anomaly_scores", "response_plan", "policy_decisions", "case_matrix", "case_dashboard",
    "technique_coverage", "episode_sessions", "realtime_summary", "dedupe_records", "envelope_validation",
    "stream_correlation", "stream_evaluation", "case_matrix_engines", "correlated_alert_documents", "stream_summary", "stream_latest",
)
#: The headline queries read this table only.
TABLE = "events.parquet"


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, "huntframe-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
        spark.sparkContext.setLogLevel("ERROR")
        laid_out = scratch_path(spark, "bench")
        source = spark.read.parquet(f"{sf_dir}/{TABLE}")
        rows = source.count()
        source.repartitionByRange(int(cpus) if cpus.isdigit() else 8, "event_id").write.parquet(f"{laid_out}/{TABLE}")
        times = {}
        for name in HEADLINE:
            run(spark, name, laid_out)
            times[name] = round(run(spark, name, laid_out), 3)
            print(f"{name}: {times[name]}s", flush=True)
        clean_scratch(spark)
        spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": rows,
                "detect_events_per_sec": round(rows / times["alert_documents"]),
            }
        )
    )


if __name__ == "__main__":
    main()
