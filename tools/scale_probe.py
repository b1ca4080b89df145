"""Scale probe: headline queries on k stacked copies of the input tables.

Copy ``c`` of every row gets keys shifted by ``c * 10**9`` and names suffixed with
``c``, so patients, invoices and customers of different copies are distinct and
every per-key group keeps its size while the tables grow k-fold.  Prints one JSON line.

usage: python tools/scale_probe.py [sf_dir] [copies] [query,query,...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cohortcart.plans.queries import bind  # noqa: E402
from cohortcart.session import build_session, scratch_path  # noqa: E402
from cohortcart.sources import fixtures as FX  # noqa: E402
from cohortcart.sources.tables import load_admissions, load_transactions  # noqa: E402

QUERIES = ["readmit_rate_condition", "risk_score", "risk_batch", "dataset_profile", "country_sales",
           "rfm_values", "rfm_scores", "sales_segments"]
SHIFT = 10 ** 9


def stacked(df, copies: int, shift_cols: dict, suffix_cols: list[str]):
    c = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")
    out = df.select("*", c)
    for col, cast in shift_cols.items():
        out = out.withColumn(col, (F.col(col).cast("long") + F.col("_copy").cast("long") * SHIFT).cast(cast))
    for col in suffix_cols:
        out = out.withColumn(col, F.concat(F.col(col), F.lit("#"), F.col("_copy").cast("string")))
    return out.drop("_copy")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    only = sys.argv[3].split(",") if len(sys.argv) > 3 else QUERIES
    spark = build_session("local[8]", shuffle_partitions=64)
    root = scratch_path(spark, f"scale-x{copies}")
    t = time.perf_counter()
    stacked(FX.admissions(spark, sf_dir), copies, {"Admission_ID": "long"}, ["Name"]) \
        .repartition(64).write.parquet(f"{root}/admissions")
    stacked(FX.transactions(spark, sf_dir), copies, {"InvoiceNo": "string", "CustomerID": "long"}, []) \
        .repartition(64).write.parquet(f"{root}/transactions")
    build = time.perf_counter() - t
    loaders = {"admissions": load_admissions, "transactions": load_transactions}
    report = {"copies": copies, "build_sec": round(build, 1),
              "admissions": load_admissions(spark, f"{root}/admissions").count(),
              "transactions": load_transactions(spark, f"{root}/transactions").count(), "queries": {}}
    for key in only:
        query = bind(key, lambda s, src, table: loaders[table](s, f"{src}/{table}"))
        run = lambda: query(spark, root).write.format("noop").mode("overwrite").save()
        run()
        times = []
        for _ in range(3):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        report["queries"][key] = round(statistics.median(times), 3)
        print(key, report["queries"][key], file=sys.stderr, flush=True)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
