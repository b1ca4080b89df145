"""Sales reports from one basket roll-up instead of the sales lines.

The roll-up holds one row per customer, invoice, day and country, with mergeable measures of its lines:
``lines``, ``priced`` (lines with an amount) and ``sales``, and the same three over lines of positive
quantity (``bought_lines``, ``bought_priced``, ``bought_sales``).  All six reports on known customers
follow from it exactly: sums add up, the day is kept, and a distinct count over lines is the same count
over baskets.  Lines without a customer, invoice, date or country keep baskets of their own (NULL keys).

``mark`` is a sum of row hashes over the lines' columns that the roll-up reads.  It adds up like the other measures,
so a month's lines can be compared with its stored baskets without rolling them up again
(``cohortcart.plans.basket_store`` does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.functions.rounding import avg_half_up, int_avg
from cohortcart.operators.aggregates import grouped_with_distinct
from cohortcart.operators.readmission import row_hash
from cohortcart.operators.rfm import days_since, score_values, segment_totals
from cohortcart.operators.sales import MEAN, MONEY

KEYS = ["CustomerID", "InvoiceNo", "day", "Country"]
SOURCE_COLUMNS = ["CustomerID", "InvoiceNo", "InvoiceDate", "Country", "Quantity", "Total_Sales"]
NO_MONTH = 0                       # month number of lines without a date


def month_number(day: Column) -> Column:
    """``200112`` for a day of December 2001; ``NO_MONTH`` without a day."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(NO_MONTH)).cast("int")


def line_mark() -> Column:
    """Hash of one line as a DECIMAL, to be summed."""
    return row_hash([F.col(c) for c in SOURCE_COLUMNS]).cast("decimal(20,0)")


def roll_up(lines: DataFrame) -> DataFrame:
    """The baskets of ``lines``: one scan of six columns, one hash aggregate combined map-side, so an
    invoice or customer of many lines sends one row per task."""
    positive = F.col("Quantity") > 0
    return (lines.select(*SOURCE_COLUMNS).withColumn("day", F.to_date("InvoiceDate")).withColumn("mark", line_mark())
            .groupBy(*KEYS)
            .agg(F.count(F.lit(1)).alias("lines"), F.count("Total_Sales").alias("priced"),
                 F.sum("Total_Sales").alias("sales"), F.count_if(positive).alias("bought_lines"),
                 F.count(F.when(positive, F.col("Total_Sales"))).alias("bought_priced"),
                 F.sum(F.when(positive, F.col("Total_Sales"))).alias("bought_sales"),
                 F.sum("mark").alias("mark")))


def _known(baskets: DataFrame) -> DataFrame:
    return baskets.where(F.col("CustomerID").isNotNull())


def _bought(baskets: DataFrame) -> DataFrame:
    return _known(baskets).where(F.col("bought_lines") > 0)


def monthly_trend(baskets: DataFrame, sort: bool = True) -> DataFrame:
    """``sales.monthly_trend`` over baskets."""
    out = grouped_with_distinct(
        _known(baskets), {"Year": F.year("day"), "Month": F.month("day")},
        {"InvoiceCount": "InvoiceNo", "CustomerCount": "CustomerID"},
        [F.sum("sales").cast(MONEY).alias("TotalRevenue")])
    out = out.select("Year", "Month", "InvoiceCount", "CustomerCount", "TotalRevenue")
    return out.orderBy("Year", "Month") if sort else out


def country_sales(baskets: DataFrame, sort: bool = True) -> DataFrame:
    """``sales.country_sales`` over baskets: the mean is still one of lines, from their sum and count."""
    out = (grouped_with_distinct(
        _bought(baskets), {"Country": F.col("Country")},
        {"InvoiceCount": "InvoiceNo", "CustomerCount": "CustomerID"},
        [F.sum("bought_sales").alias("_s"), F.sum("bought_priced").alias("_n")])
           .select("Country", "InvoiceCount", "CustomerCount", F.col("_s").cast(MONEY).alias("TotalRevenue"),
                   avg_half_up(F.col("_s"), F.col("_n"), MEAN).alias("AvgOrderValue")))
    return out.orderBy(F.desc("TotalRevenue")) if sort else out


def customer_behaviour(baskets: DataFrame) -> DataFrame:
    """``sales.customer_behaviour`` over baskets."""
    per = (_bought(baskets).groupBy("CustomerID")
           .agg(F.count_distinct("InvoiceNo").alias("n"), F.sum("bought_sales").cast(MONEY).alias("s"),
                F.min("day").alias("first"), F.max("day").alias("last")))
    return per.agg(F.count("CustomerID").alias("TotalCustomers"),
                   int_avg(F.sum("n"), F.count("n")).alias("AvgInvoicesPerCustomer"),
                   avg_half_up(F.sum("s"), F.count("s"), MEAN).alias("AvgSpentPerCustomer"),
                   F.min("first").alias("EarliestFirstPurchase"), F.max("last").alias("LatestLastPurchase"))


def rfm_values(baskets: DataFrame, as_of, sort: bool = True) -> DataFrame:
    """``rfm.rfm_values`` over baskets."""
    out = (_known(baskets).groupBy("CustomerID")
           .agg(days_since(F.max("day"), as_of).alias("Recency"), F.count_distinct("InvoiceNo").alias("Frequency"),
                F.sum("bought_sales").cast(MONEY).alias("Monetary"), F.sum("bought_lines").alias("_bought"))
           .where("_bought > 0").drop("_bought"))
    if sort:
        out = out.orderBy(F.asc("Recency"), F.desc("Frequency"), F.desc("Monetary"), F.asc("CustomerID"))
    return out


def rfm_scores(baskets: DataFrame, as_of, **options) -> DataFrame:
    """``rfm.rfm_scores`` over baskets."""
    return score_values(rfm_values(baskets, as_of, sort=False), **options)


def sales_segments(baskets: DataFrame, **options) -> DataFrame:
    """``rfm.sales_segments`` over baskets."""
    totals = _known(baskets).groupBy("CustomerID").agg(F.sum("sales").cast(MONEY).alias("TotalSales"))
    return segment_totals(totals, **options)
