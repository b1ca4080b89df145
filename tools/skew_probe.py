"""Skew probe: the largest task of the readmission flag when one patient holds a third of the rows.

Derives a skewed copy of the admissions fixture (every third admission is given to
one patient), then runs the readmission rate twice - with the library's ``readmission_rate``
and with a plain ``LEAD ... OVER (PARTITION BY Name ...)`` window - and reports, from
the Spark event log, the most rows one task read from a shuffle in each variant.

usage: python tools/skew_probe.py [sf_dir] [patient|copies|customer]

``copies`` also gives the hot patient's rows one day, so a third of the rows share
one (patient, day) key: the day table combines them before its shuffle, and the
join of rows to the day table relies on AQE splitting the hot partition.
``customer`` gives a third of the sales lines to one customer and one invoice and
reports the largest task of the per-customer aggregates.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cohortcart.operators import readmission as RA  # noqa: E402
from cohortcart.session import build_session, scratch_path  # noqa: E402
from cohortcart.sources import fixtures as FX  # noqa: E402
from cohortcart.sources.tables import load_admissions  # noqa: E402


def plain_flag(df):
    w = Window.partitionBy("Name").orderBy("Date_of_Admission", "Admission_ID")
    nxt = df.withColumn("next_admission", F.lead("Date_of_Admission").over(w))
    return nxt.withColumn("is_readmission", F.when(
        F.datediff("next_admission", "Discharge_Date").between(1, 30), 1).otherwise(0))


def max_task_shuffle_rows(log_dir: str) -> dict[str, int]:
    """job group -> the most shuffle records read by one task of any of its jobs."""
    stage_group, out = {}, {}
    for path in sorted(glob.glob(f"{log_dir}/**/events_*", recursive=True)):
        with open(path, "rb") as raw:
            data = raw.read()
        if path.endswith(".zstd"):
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
        for line in data.decode().splitlines():
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "other")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
            elif kind == "SparkListenerTaskEnd":
                metrics = ev.get("Task Metrics") or {}
                read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                group = stage_group.get(ev["Stage ID"], "other")
                out[group] = max(out.get(group, 0), read)
    return out


def customer_probe(spark, sf_dir: str, root: str, log_dir: str) -> None:
    """A third of the sales lines belong to one customer and one invoice: the per-customer
    aggregates must combine them before any shuffle."""
    from cohortcart.operators import rfm as RFM
    from cohortcart.operators import sales as S
    from cohortcart.sources.tables import load_transactions
    tx = FX.transactions(spark, sf_dir)
    hot = F.abs(F.xxhash64("InvoiceNo", "StockCode", "Quantity")) % 3 == 0
    tx = (tx.withColumn("CustomerID", F.when(hot, F.lit(1)).otherwise(F.col("CustomerID")))
          .withColumn("InvoiceNo", F.when(hot, F.lit("HOT")).otherwise(F.col("InvoiceNo"))))
    tx.repartition(32).write.parquet(root)
    table = load_transactions(spark, root)
    report = {"scenario": "customer", "rows": table.count(),
              "hot_customer_rows": table.filter(F.col("CustomerID") == 1).count()}
    variants = {"rfm_values": lambda: RFM.rfm_values(table, "2002-01-01", sort=False),
                "customer_behaviour": lambda: S.customer_behaviour(table),
                "sales_segments": lambda: RFM.sales_segments(table, sort=False),
                "rfm_scores": lambda: RFM.rfm_scores(table, "2002-01-01", sort=False)}
    for label, build in variants.items():
        spark.sparkContext.setJobGroup(label, label)
        build().write.format("noop").mode("overwrite").save()
    spark.stop()
    report["max_task_shuffle_rows"] = max_task_shuffle_rows(log_dir)
    print(json.dumps(report, default=str))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scenario = sys.argv[2] if len(sys.argv) > 2 else "patient"
    log_dir = tempfile.mkdtemp(prefix="run-eventlog-", dir="/tmp")
    # no partition coalescing: every hash partition is one task, as on a large input; AQE's skew
    # thresholds scaled down to this input (defaults: 256MB and 5x the median)
    spark = build_session("local[8]", shuffle_partitions=32,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                                 "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"})
    root = scratch_path(spark, "skew-probe")
    if scenario == "customer":
        customer_probe(spark, sf_dir, root, log_dir)
        return
    adm = FX.admissions(spark, sf_dir)
    hot = F.col("Admission_ID") % 3 == 0
    skewed = adm.withColumn("Name", F.when(hot, F.lit("HOT PATIENT")).otherwise(F.col("Name")))
    if scenario == "copies":          # a third of the rows: one patient on one day
        skewed = skewed.withColumn("Date_of_Admission", F.when(hot, F.lit("2000-01-01").cast("date"))
                                   .otherwise(F.col("Date_of_Admission")))
    skewed.repartition(32).write.parquet(root)
    table = load_admissions(spark, root)
    rows = table.count()

    report = {"scenario": scenario, "rows": rows,
              "hot_patient_rows": table.filter(F.col("Name") == "HOT PATIENT").count()}
    variants = {
        "readmission_rate": lambda: RA.readmission_rate(table, "Medical_Condition", sort=False),
        "plain_window": lambda: RA.rate_from_flags(plain_flag(table), "Medical_Condition", sort=False),
    }
    for build in variants.values():                      # warm-up, outside the measured job groups
        build().write.format("noop").mode("overwrite").save()
    results = {}
    for label, build in variants.items():
        spark.sparkContext.setJobGroup(label, label)
        t = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        report[f"{label}_sec"] = round(time.perf_counter() - t, 3)
        results[label] = sorted((str(r[0]), *r[1:]) for r in build().collect())
    spark.stop()
    report["max_task_shuffle_rows"] = max_task_shuffle_rows(log_dir)
    report["same_result"] = len({tuple(v) for v in results.values()}) == 1
    print(json.dumps(report, default=str))


if __name__ == "__main__":
    main()
