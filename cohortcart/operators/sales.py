"""Sales summaries: monthly trend, country ranking, customer behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcart.functions.rounding import avg_half_up, int_avg
from cohortcart.operators.aggregates import grouped_with_distinct

MONEY = "decimal(38,5)"        # SUM of a DECIMAL(18,5) money column
MEAN = 6                       # decimal places of a money average


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("CustomerID").isNotNull())


def _purchases(df: DataFrame) -> DataFrame:
    return df.filter(F.col("CustomerID").isNotNull() & (F.col("Quantity") > 0))


def monthly_trend(df: DataFrame, sort: bool = True) -> DataFrame:
    """Per calendar month of lines with a known customer (returns included):
    distinct invoices, distinct customers and revenue."""
    day = F.to_date(F.col("InvoiceDate"))
    out = grouped_with_distinct(
        _known(df), {"Year": F.year(day), "Month": F.month(day)},
        {"InvoiceCount": "InvoiceNo", "CustomerCount": "CustomerID"},
        [F.sum("Total_Sales").cast(MONEY).alias("TotalRevenue")])
    out = out.select("Year", "Month", "InvoiceCount", "CustomerCount", "TotalRevenue")
    return out.orderBy("Year", "Month") if sort else out


def country_sales(df: DataFrame, sort: bool = True) -> DataFrame:
    """Per country, purchases only (known customer, positive quantity): distinct invoices and
    customers, revenue and the mean *line* value (``AvgOrderValue``), by revenue descending."""
    out = (grouped_with_distinct(
        _purchases(df), {"Country": F.col("Country")},
        {"InvoiceCount": "InvoiceNo", "CustomerCount": "CustomerID"},
        [F.sum("Total_Sales").alias("_s"), F.count("Total_Sales").alias("_n")])
           .select("Country", "InvoiceCount", "CustomerCount",
                   F.col("_s").cast(MONEY).alias("TotalRevenue"),
                   avg_half_up(F.col("_s"), F.col("_n"), MEAN).alias("AvgOrderValue")))
    return out.orderBy(F.desc("TotalRevenue")) if sort else out


def customer_summary(df: DataFrame) -> DataFrame:
    """Per customer with purchases: distinct invoices, spend, first and last purchase day."""
    day = F.to_date(F.col("InvoiceDate"))
    return (_purchases(df).groupBy("CustomerID")
            .agg(F.count_distinct("InvoiceNo").alias("InvoiceCount"),
                 F.sum("Total_Sales").cast(MONEY).alias("TotalSpent"),
                 F.min(day).alias("FirstPurchaseDate"), F.max(day).alias("LastPurchaseDate")))


def customer_behaviour(df: DataFrame) -> DataFrame:
    """One row over the per-customer summary.  ``AvgInvoicesPerCustomer`` is an integer average
    (truncated); ``TotalCustomers`` counts summary rows, which are one per known customer."""
    per = customer_summary(df)
    return per.agg(
        F.count("CustomerID").alias("TotalCustomers"),
        int_avg(F.sum("InvoiceCount"), F.count("InvoiceCount")).alias("AvgInvoicesPerCustomer"),
        avg_half_up(F.sum("TotalSpent"), F.count("TotalSpent"), MEAN).alias("AvgSpentPerCustomer"),
        F.min("FirstPurchaseDate").alias("EarliestFirstPurchase"),
        F.max("LastPurchaseDate").alias("LatestLastPurchase"))
