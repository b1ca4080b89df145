"""Global order by a key of few values, placed by counting instead of by sampling.

``orderBy`` finds its ranges from a sample, which runs the input a second time, and a range cannot
split rows of one key value unless the order goes on.  Here the input is stored once, a histogram over
(key, cell of the tie-breaker) is counted from two of its columns, and running totals of the histogram say
which partition each cell belongs to: rows go there directly and are sorted inside.  A cell is a power-of-two
range of the tie-breaker, so cells are in the order of the rows, and a key that all rows share is split
as evenly as its cells are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcart.session import cluster_parallelism, stored

MAX_CELLS = 200_000                # of a histogram; beyond it the key is not one of few values


def _shift(lo: int, hi: int, cells: int) -> int:
    """Low bits to drop so that at most ``cells`` ranges of the tie-breaker are left."""
    shift = 0
    while (hi >> shift) - (lo >> shift) >= cells:
        shift += 1
    return shift


def order_by_counts(df: DataFrame, key: str, tie: str, ascending: bool = True, rows_per_partition: int = 2_000_000,
                    cells_per_key: int = 512, store: bool = True) -> DataFrame:
    """``df`` ordered by ``key`` and then by ``tie`` ascending, over partitions of near-equal size.

    ``key`` has few distinct values and ``tie`` is a BIGINT (an id or a hash).  NULL keys come first
    ascending and last descending, NULL ties first, as in ``orderBy``.  Rows equal in both stay together.
    Where the histogram has more than ``MAX_CELLS`` cells, Spark's own ``orderBy`` takes over; the result is the same.
    ``store=False`` leaves out the storing of an input that is cheap to read twice."""
    held = stored(df, "to-place") if store else df
    span = held.agg(F.min(tie).alias("lo"), F.max(tie).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    order = [F.asc(key) if ascending else F.desc(key), F.asc_nulls_first(tie)]
    if not span["n"]:
        return held.orderBy(*order)
    lo, hi = span["lo"] or 0, span["hi"] or 0
    cell = F.coalesce(F.shiftright(F.col(tie), _shift(lo, hi, cells_per_key)), F.lit(-1 << 63))
    keyed = held.withColumn("_cell", cell)
    counts = keyed.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_CELLS + 1).collect()
    if len(counts) > MAX_CELLS:
        return held.orderBy(*order)
    partitions = max(cluster_parallelism(df.sparkSession), -(-span["n"] // rows_per_partition))
    groups: dict = {}
    for value, c, n in counts:
        groups.setdefault(value, []).append((c, n))
    known = sorted((v for v in groups if v is not None), reverse=not ascending)
    missing = [None] if None in groups else []
    places, before = [], 0
    for value in (missing + known if ascending else known + missing):
        for c, n in sorted(groups[value]):
            places.append((value, c, (before + n // 2) * partitions // span["n"]))
            before += n
    kind = held.schema[key].dataType.simpleString()
    where = df.sparkSession.createDataFrame(places, f"_key {kind}, _at BIGINT, _place INT")
    placed = keyed.join(F.broadcast(where), keyed[key].eqNullSafe(where["_key"]) & (keyed["_cell"] == where["_at"]))
    return (placed.repartitionById(partitions, "_place").sortWithinPartitions(*order)
            .select(*held.columns))
