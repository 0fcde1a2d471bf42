"""Benchmark the headline query keys.

Runs each key at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8). Each query is materialized through the
``noop`` sink — the whole plan executes, nothing is collected — once cold and
``$BENCH_RUNS`` times warm; the reported time is the warm median. The
reference's own timed load jobs (``wl_*``, see strata/workloads.py) run with
as many generated rows as ``lineitem`` has at that scale factor. Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.registry import QUERIES  # noqa: E402
from strata.session import get_session  # noqa: E402
from strata.workloads import WORKLOADS  # noqa: E402

HEADLINE = [
    "group_stats", "avg_max", "conditional_columns", "daily_metrics", "period_counts",
    "row_count", "rank_in_group", "top_in_group", "children_per_parent", "children_zero",
    "orphans", "top_parents", "column_profile", "infer_relationships", "join_formats",
    "partition_roundtrip", "format_roundtrip", "clean_columns", "upsert_documents",
    "manifest", "retention_plan", "route_numbers", "backup_plan", "upload_plan", "er_edges",
]


def run(spark, key: str, sf_dir: str, n: int) -> float:
    t0 = time.perf_counter()
    if key in WORKLOADS:
        WORKLOADS[key](spark, n)
    else:
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = sys.argv[1:] or HEADLINE + list(WORKLOADS)
    spark = get_session(f"local[{cpus}]", app="strata-bench", shuffle_partitions=cpus * 2,
                        conf={"spark.driver.memory": "16g"})
    # the reference's generated workloads are sized like the scale factor's lineitem
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for key in keys:
        try:
            run(spark, key, sf_dir, n)  # cold: file listing, codegen, JIT
            warm = [run(spark, key, sf_dir, n) for _ in range(runs)]
            times[key] = round(statistics.median(warm), 3)
        except Exception as e:  # noqa: BLE001 - one failing key must not lose the record
            errors[key] = f"{type(e).__name__}: {str(e)[:200]}"
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        **({"errors": errors} if errors else {}),
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
