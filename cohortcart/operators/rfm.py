"""Recency-frequency-monetary values, quintile scores and value segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcart.functions.bands import SALES_SEGMENT_ORDER, SALES_SEGMENTS, first_match, SALES_SEGMENT_ELSE
from cohortcart.functions.rounding import pct_half_up_decimal
from cohortcart.operators.ranking import ntiles
from cohortcart.operators.sales import MONEY
from cohortcart.operators.shares import share_by
from cohortcart.session import stored


def _day(as_of) -> F.Column:
    return F.lit(as_of.isoformat() if isinstance(as_of, dt.date) else str(as_of)).cast("date")


def days_since(day: F.Column, as_of) -> F.Column:
    return F.datediff(_day(as_of), day)


def rfm_values(df: DataFrame, as_of, sort: bool = True) -> DataFrame:
    """Per known customer: ``Recency`` (days from the last purchase day to ``as_of``),
    ``Frequency`` (distinct invoices) - both over all lines - and ``Monetary`` (spend over
    positive-quantity lines).  Customers without any positive-quantity line are left out.

    One scan and one aggregate: the three per-customer aggregates and their inner joins are a
    single ``groupBy`` with conditional aggregates.
    """
    positive = F.col("Quantity") > 0
    out = (df.filter(F.col("CustomerID").isNotNull()).groupBy("CustomerID")
           .agg(days_since(F.max(F.to_date(F.col("InvoiceDate"))), as_of).alias("Recency"),
                F.count_distinct("InvoiceNo").alias("Frequency"),
                F.sum(F.when(positive, F.col("Total_Sales"))).cast(MONEY).alias("Monetary"),
                F.count_if(positive).alias("_bought"))
           .filter(F.col("_bought") > 0).drop("_bought"))
    if sort:
        out = out.orderBy(F.col("Recency").asc(), F.col("Frequency").desc(), F.col("Monetary").desc(),
                          F.col("CustomerID").asc())
    return out


def rfm_scores(df: DataFrame, as_of, **options) -> DataFrame:
    """``score_values`` of the customers of ``df``."""
    return score_values(rfm_values(df, as_of, sort=False), **options)


def score_values(values: DataFrame, tiles: int = 5, best_high: bool = False, sort: bool = True,
                 **ntile_options) -> DataFrame:
    """Quintile scores: ``NTILE`` over Recency ascending, Frequency and Monetary descending
    (``CustomerID`` breaks ties), and their sum.  Tile 1 holds the best customers; with
    ``best_high=True`` the scale is flipped so that ``tiles`` is best.

    The per-customer values are stored once under the session's checkpoint folder; the boundary keys of
    all three scores are found over them together, and the scores are comparisons with those keys.
    """
    values = stored(values, "rfm-values")
    orders = {"RecencyScore": [("Recency", True), ("CustomerID", True)],
              "FrequencyScore": [("Frequency", False), ("CustomerID", True)],
              "MonetaryScore": [("Monetary", False), ("CustomerID", True)]}
    scored = ntiles(values, tiles, orders, **ntile_options)
    scores = ["RecencyScore", "FrequencyScore", "MonetaryScore"]
    cols = [(tiles + 1 - F.col(c)).alias(c) if best_high else F.col(c) for c in scores]
    out = scored.select("CustomerID", *cols)
    out = out.withColumn("RFMScore", F.col("RecencyScore") + F.col("FrequencyScore") + F.col("MonetaryScore"))
    return out.orderBy(F.desc("RFMScore"), F.asc("CustomerID")) if sort else out


def customer_totals(df: DataFrame) -> DataFrame:
    """Per known customer: total sales, returns included."""
    return (df.filter(F.col("CustomerID").isNotNull()).groupBy("CustomerID")
            .agg(F.sum("Total_Sales").cast(MONEY).alias("TotalSales")))


def sales_segments(df: DataFrame, **options) -> DataFrame:
    """``segment_totals`` of the customers of ``df``."""
    return segment_totals(customer_totals(df), **options)


def segment_totals(totals: DataFrame, bands=SALES_SEGMENTS, default: str = SALES_SEGMENT_ELSE,
                   order=SALES_SEGMENT_ORDER, sort: bool = True) -> DataFrame:
    """Customers per value segment and their share of all customers (DECIMAL(5,2), half-up).

    Totals that fall between two bands (e.g. 1999.5) are not in any band and take ``default``.
    """
    seg = totals.select("CustomerID", first_match("TotalSales", bands, default).alias("SalesSegment"))
    return share_by(seg, "SalesSegment", "CustomerCount", "PercentageOfTotal",
                    lambda c, n: pct_half_up_decimal(c, n, 5, 2), order, count_col="CustomerID", sort=sort)
