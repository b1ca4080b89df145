"""Grouped aggregates with several exact distinct counts, without ``Expand``.

``groupBy(k).agg(count_distinct(a), count_distinct(b), sum(x))`` is planned by
Spark as one aggregate over an ``Expand`` that emits every row once per distinct
column plus once for the rest.  Here each distinct count is its own two-phase
aggregate over only the key and that column (deduplicated map-side before the
shuffle), and the per-group results - one row per group - are joined on the keys
(NULL-safe, so a NULL group keeps its counts).  On 9.6M rows this ran in about
two thirds of the ``Expand`` plan's time; on 600k rows it is slightly slower.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_with_distinct(df: DataFrame, keys: dict[str, Column], distinct: dict[str, str],
                          aggs: list[Column]) -> DataFrame:
    """``keys`` (name -> expression) per group, ``aggs``, and for each ``name -> column`` of
    ``distinct`` the number of distinct non-NULL values of the column in the group."""
    names = list(keys)
    rest = [c for c in df.columns if c not in keys]
    keyed = df.select(*[expr.alias(name) for name, expr in keys.items()], *rest)
    out = keyed.groupBy(*names).agg(*aggs)
    for count_name, column in distinct.items():
        renamed = {n: f"_{count_name}_{n}" for n in names}
        counts = (keyed.select(*[F.col(n).alias(renamed[n]) for n in names], F.col(column))
                  .where(F.col(column).isNotNull()).distinct()
                  .groupBy(*renamed.values()).agg(F.count(F.lit(1)).alias(count_name)))
        on = reduce(lambda a, b: a & b, [out[n].eqNullSafe(counts[renamed[n]]) for n in names])
        out = (out.join(counts, on, "left")
               .withColumn(count_name, F.coalesce(F.col(count_name), F.lit(0).cast("long")))
               .drop(*renamed.values()))
    return out
