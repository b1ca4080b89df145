"""Data-quality operators: column listing, NULL audits, mean imputation, dataset profile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from cohortcart.functions.rounding import avg_half_up


def list_columns(df: DataFrame) -> DataFrame:
    """``COLUMN_NAME`` of every column of ``df``, in schema order (metadata only, no scan)."""
    spark = df.sparkSession
    return spark.createDataFrame([(f.name,) for f in df.schema.fields], "COLUMN_NAME string")


def list_table_columns(spark, table: str) -> DataFrame:
    """``COLUMN_NAME`` of every column of a catalog table, read from the catalog (no scan)."""
    return spark.createDataFrame([(c.name,) for c in spark.catalog.listColumns(table)], "COLUMN_NAME string")


def missing_audit(df: DataFrame, columns: Sequence[str] | None = None,
                  names: Sequence[str] | None = None, prefix: str = "Missing_") -> DataFrame:
    """One row with the number of NULLs of each column (NULL counts on an empty table are NULL).

    One global aggregate: a partial count per task, one row per task to the final merge.
    """
    columns = list(columns or df.columns)
    names = list(names or [prefix + c for c in columns])
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(n)
                    for c, n in zip(columns, names)])


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Replace NULLs of ``column`` by the mean of its non-NULL values.

    The mean is taken over the whole input before any replacement and rounded half-up to the
    column's own scale (the value is stored back into a column of that type).  One 1-row
    aggregate, broadcast to the rows; other columns and the column order are unchanged.
    """
    dtype = df.schema[column].dataType
    if isinstance(dtype, DecimalType):
        stats = df.agg(F.sum(column).alias("_s"), F.count(column).alias("_n"))
        mean = avg_half_up(F.col("_s"), F.col("_n"), dtype.scale, dtype.precision)
    else:
        stats = df.agg(F.avg(column).alias("_s"))
        mean = F.col("_s").cast(dtype)
    one = F.broadcast(stats.select(mean.alias("_mean")))
    return (df.crossJoin(one)
            .withColumn(column, F.coalesce(F.col(column), F.col("_mean")).cast(dtype))
            .drop("_mean"))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """1-row exact ``COUNT(DISTINCT column)``: dedupe (map-side first), then count."""
    return (df.select(column).where(F.col(column).isNotNull())
            .distinct().agg(F.count(F.lit(1)).alias(name)))


def profile(df: DataFrame, invoice: str = "InvoiceNo", customer: str = "CustomerID",
            product: str = "StockCode", country: str = "Country", date: str = "InvoiceDate") -> DataFrame:
    """Rows, distinct invoices / customers / products / countries, first and last day, day span.

    Each exact distinct count is its own two-phase aggregate over one column, so no row is
    expanded per distinct column; the 1-row results are cross-joined.  Each reads ``df`` again
    (only its column when ``df`` is a stored table); checkpoint a costly derived input first.
    """
    day = F.to_date(F.col(date))
    base = df.agg(F.count(F.lit(1)).alias("TotalRows"),
                  F.min(day).alias("EarliestDate"), F.max(day).alias("LatestDate"))
    parts = [distinct_count(df, invoice, "TotalInvoices"), distinct_count(df, customer, "TotalCustomers"),
             distinct_count(df, product, "TotalProducts"), distinct_count(df, country, "TotalCountries")]
    out = reduce(lambda a, b: a.crossJoin(b), parts, base)
    return out.select("TotalRows", "TotalInvoices", "TotalCustomers", "TotalProducts", "TotalCountries",
                      "EarliestDate", "LatestDate",
                      F.datediff(F.col("LatestDate"), F.col("EarliestDate")).alias("DateRangeInDays"))
