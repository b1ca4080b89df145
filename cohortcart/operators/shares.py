"""Counts per label with their share of the total, in a fixed label order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.functions.bands import rank_of


def share_by(df: DataFrame, label: str, count_name: str, pct_name: str,
             pct: Callable[[Column, Column], Column], order: Sequence[str] | None = None,
             count_col: str | None = None, sort: bool = True) -> DataFrame:
    """Rows (or non-NULL ``count_col`` values) per ``label`` and ``pct(count, all rows)``.

    The input is aggregated to one row per label; the total is a 1-row sum over that result,
    broadcast back.  Both branches read the same aggregate exchange, so the input is scanned
    once, and no step gathers the labels in one partition whatever their number.
    """
    counter = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    grouped = df.groupBy(label).agg(counter.alias(count_name), F.count(F.lit(1)).alias("_rows"))
    total = grouped.agg(F.sum("_rows").alias("_total"))          # one row
    out = (grouped.crossJoin(F.broadcast(total))
           .withColumn(pct_name, pct(F.col(count_name), F.col("_total")))
           .drop("_rows", "_total"))
    if sort and order is not None:
        out = out.orderBy(rank_of(label, order))
    return out
