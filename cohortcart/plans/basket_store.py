"""The stored basket roll-up: kept by month, brought up to date for changed months only.

Layout under ``location`` (shared storage)::

    baskets/<version>/month=<yyyymm>/   the baskets that one refresh wrote
    ledger/                             month, version, generation: which version of a month is in force

A refresh writes the baskets of the changed months into a version of their own and then appends one
ledger row per month.  Readers follow the ledger, so they see the state before or after a refresh and
never a part of one; a refresh that dies in between leaves files nobody reads and is simply run again.
A month whose lines are all gone gets a ledger row without a version.  The ledger holds one row per month
and refresh, and only its months in force (bounded by the calendar) reach the driver.

One refresh at a time per location.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cohortcart.operators.baskets import NO_MONTH, SOURCE_COLUMNS, line_mark, month_number, roll_up

LEDGER_SCHEMA = "month INT, version STRING, generation BIGINT"
BASKET_SCHEMA = ("CustomerID BIGINT, InvoiceNo STRING, day DATE, Country STRING, lines BIGINT, priced BIGINT, "
                 "sales DECIMAL(28,5), bought_lines BIGINT, bought_priced BIGINT, bought_sales DECIMAL(28,5), "
                 "mark DECIMAL(30,0)")


def _ledger(spark: SparkSession, location: str) -> tuple[dict[int, str], int]:
    """Version in force per month, and the last generation (0: nothing stored yet)."""
    try:
        rows = (spark.read.schema(LEDGER_SCHEMA).parquet(f"{location}/ledger").groupBy("month")
                .agg(F.max_by("version", "generation").alias("version"), F.max("generation").alias("generation")).collect())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}, 0
    return {r["month"]: r["version"] for r in rows if r["version"]}, max((r["generation"] for r in rows), default=0)


def read(spark: SparkSession, location: str, months: Iterable[int] | None = None) -> DataFrame:
    """The baskets in force, of ``months`` only when given (their folders alone are read)."""
    versions, _ = _ledger(spark, location)
    wanted = versions.keys() if months is None else versions.keys() & set(months)
    paths = [f"{location}/baskets/{versions[m]}/month={m}" for m in sorted(wanted)]
    if not paths:
        return spark.createDataFrame([], BASKET_SCHEMA)
    return spark.read.schema(BASKET_SCHEMA).parquet(*paths)


def _first_of(month: int) -> Column:
    return F.lit(f"{month // 100:04d}-{month % 100:02d}-01 00:00:00").cast("timestamp_ntz")


def _following(month: int) -> int:
    return month + 1 if month % 100 < 12 else month + 89


def in_months(months: Iterable[int], date: str = "InvoiceDate") -> Column:
    """Whether ``date`` lies in one of ``months``: ranges over runs of months, which reach the scan."""
    tests, runs = [], []
    for m in sorted(set(months)):
        if m == NO_MONTH:
            tests.append(F.col(date).isNull())
        elif runs and runs[-1][1] == m:
            runs[-1][1] = _following(m)
        else:
            runs.append([m, _following(m)])
    tests += [(F.col(date) >= _first_of(lo)) & (F.col(date) < _first_of(hi)) for lo, hi in runs]
    return reduce(or_, tests, F.lit(False))


def changed_months(lines: DataFrame, location: str) -> list[int]:
    """Months whose lines are not those that the stored baskets were made of: lines added, removed or altered
    in a column the roll-up reads.  One narrow aggregate over the lines, one over the baskets."""
    spark = lines.sparkSession
    now = (lines.select(month_number(F.to_date("InvoiceDate")).alias("month"), line_mark().alias("mark"))
           .groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").cast("decimal(38,0)").alias("mark")))
    then = (read(spark, location).groupBy(month_number(F.col("day")).alias("old"))
            .agg(F.sum("lines").alias("old_n"), F.sum("mark").cast("decimal(38,0)").alias("old_mark")))
    both = now.join(then, F.col("month") == F.col("old"), "full_outer")
    same = F.col("n").eqNullSafe(F.col("old_n")) & F.col("mark").eqNullSafe(F.col("old_mark"))
    return sorted(r[0] for r in both.where(~same).select(F.coalesce("month", "old")).collect())


def refresh(lines: DataFrame, location: str, months: Iterable[int] | None = None) -> list[int]:
    """Brings the baskets at ``location`` up to date with ``lines`` and returns the months written or removed.

    ``months`` names the months to roll up again where the caller knows them (then other lines are not
    read at all); otherwise they are found by ``changed_months``.  The first refresh rolls up everything in
    one read.  The write is rebalanced by month, so Spark splits a large month over several files and
    puts small ones into one."""
    spark = lines.sparkSession
    lines = lines.select(*SOURCE_COLUMNS)
    versions, generation = _ledger(spark, location)
    if months is None and generation:
        months = changed_months(lines, location)
    if months is not None:
        months = sorted(set(months))
        if not months:
            return []
        lines = lines.where(in_months(months))
    version = uuid.uuid4().hex[:12]
    path = f"{location}/baskets/{version}"
    baskets = roll_up(lines).withColumn("month", month_number(F.col("day"))).hint("rebalance", "month")
    baskets.write.partitionBy("month").parquet(path)
    written = _months_under(spark, path)
    gone = [m for m in months or [] if m not in written and m in versions]
    rows = [(m, version, generation + 1) for m in written] + [(m, "", generation + 1) for m in gone]
    if rows:
        spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{location}/ledger")
    return sorted(written + gone)


def _months_under(spark: SparkSession, path: str) -> list[int]:
    """Months that a write left folders for (asked of the file system that Spark uses; no job)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/month=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found or [])
