"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

The two input tables are derived from the test parquet once and stored as
several files (as the real inputs would be); each query then runs over the stored tables, with a
``noop`` write so every row is computed.  Per query: median of $BENCH_RUNS warm
runs after one warm-up.  Prints ONE JSON line on stdout; ``value`` is the sum of
as warm-up before any timing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortcart.plans.queries import TABLE_QUERIES, bind  # noqa: E402
from cohortcart.session import build_session, scratch_path  # noqa: E402
from cohortcart.sources import fixtures as FX  # noqa: E402
from cohortcart.sources.tables import load_admissions, load_transactions  # noqa: E402

HEADLINE = ["readmit_rate_condition", "risk_score", "risk_batch", "dataset_profile", "country_sales",
            "rfm_values", "rfm_scores", "sales_segments"]
LOADERS = {"admissions": load_admissions, "transactions": load_transactions}


def _scale_factor(sf_dir: str):
    name = os.path.basename(sf_dir).replace("sf", "")
    try:
        return float(name)
    except ValueError:
        return name


def _timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=partitions,
                          extra={"spark.ui.showConsoleProgress": "false"})

    # stored as a table would be: several similar files (the source parquet is a single row group,
    # which would make every scan one task)
    files = int(os.environ.get("BENCH_INPUT_FILES", str(partitions)))
    root = scratch_path(spark, "bench-inputs")
    fixture_sec = _timed(lambda: [
        FX.admissions(spark, sf_dir).repartition(files).write.parquet(f"{root}/admissions"),
        FX.transactions(spark, sf_dir).repartition(files).write.parquet(f"{root}/transactions")])

    def inputs(spark_, src, table):
        return LOADERS[table](spark_, f"{src}/{table}")

    def runner(key):
        query = bind(key, inputs)
        return lambda: query(spark, root).write.format("noop").mode("overwrite").save()

    keys = only or list(TABLE_QUERIES)
    for key in keys:                                        # warm-up pass over every query (JIT, caches)
        runner(key)()
    results = {}
    for key in keys:
        run_once = runner(key)
        results[key] = round(statistics.median(_timed(run_once) for _ in range(runs)), 4)
        print(f"{key}: {results[key]}", file=sys.stderr, flush=True)

    headline = {k: results[k] for k in HEADLINE if k in results}
    print(json.dumps({
        "metric": "headline_sum_median_sec", "value": round(sum(headline.values()), 4), "unit": "sec",
        "queries": results, "headline": HEADLINE, "sf": _scale_factor(sf_dir),
        "cpus": cpus, "shuffle_partitions": partitions, "runs": runs,
        "input_build_sec": round(fixture_sec, 3), "input_files": files, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
