"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is written to the
no-op sink, so every output column is computed; the best of two runs counts, the first of
which also warms the code paths. `rows_per_sec` gives the throughput of the record jobs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from redactstream.plans.catalog import QUERIES
from redactstream.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

# Query and the table whose rows it processes one by one, if any.
HEADLINE = {
    "redact_documents": "documents",
    "scan_batch": "documents",
    "reencode_envelope": "orders",
    "detect_rules_fields": "orders",
    "scan_result": "orders",
    "model_spans": "orders",
    "merge_islands": None,
    "rep_entities": None,
    "rep_disposition": None,
    "rep_uncertain": None,
    "report_sections": None,
    "audit_upsert_messages": None,
    "audit_upsert_findings": None,
    "latency_percentiles": None,
    "eval_cube": None,
    "span_measures": None,
    "token_frequency": None,
    "weak_sentences": None,
    "best_typed_dedup": None,
    "stream_routed": "orders",
}


def main(names: list[str]) -> None:
    spark = local_session(CPUS, app="bench", **{"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in names or HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
        if HEADLINE.get(name):
            rows = spark.read.parquet(f"{SF_DIR}/{HEADLINE[name]}.parquet").count()
            rates[name] = round(rows / best, 1)
        print(f"{name} {best:.3f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
