"""Times the headline queries and prints one JSON line: the median of warm runs of each.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import all_queries  # noqa: E402
from tallymark.session import build_session, discard_stored  # noqa: E402

HEADLINE = (
    "norm_numeric", "norm_string", "row_count_by_group", "reconciliation", "diff_summary",
    "diff_cells", "diff_duplicate_keys", "datatype_conformance", "completeness_values",
    "fk_orphans", "fk_summary", "dedup_summary", "dedup_rows", "zero_vs_null",
    "aggregate_variance", "historical_immutability", "incremental_delta", "rule_summary",
    "rule_unique", "rule_split_distinct", "report_data", "report_measures",
    "history_pass_rate_delta", "history_failure_streak", "history_category_health",
    "suite_run",
)

#: Not in the total, so that it stays comparable: newer forms of queries above, and scans of files.
MORE = ("reconciliation_pruned", "reconciliation_bucketed", "fk_orphans_settled", "dedup_rows_settled", "scan_glob_lineage",
        "scan_glob_many_headers", "scan_typed", "history_compacted", "suite_metrics")

#: Warm runs of each query, and of those not in the total.
RUNS, MORE_RUNS = 3, 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus),
                          driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the engine

    def timed(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    def warm(names, runs: int) -> dict[str, float]:
        times = {}
        for name in names:
            timed(name)  # compiles code and loads classes
            times[name] = round(median(timed(name) for _ in range(runs)), 3)
            discard_stored(spark)
        return times

    times = warm(chosen, RUNS)
    more = {} if sys.argv[1:] else warm(MORE, MORE_RUNS)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "more": more, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
