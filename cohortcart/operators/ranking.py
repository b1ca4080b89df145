"""Exact global row numbers and ``NTILE`` without moving all rows to one partition.

``ROW_NUMBER() OVER (ORDER BY ...)`` with no ``PARTITION BY`` is planned by Spark as one task over all
rows.  Two other ways, both exact:

* *Row numbers*: Spark's own range partitioning and sort, with as many ranges as keep each at about
  ``ROWS_PER_RANGE`` rows, however many that makes.  The sorted rows are stored once; a row's place in its
  range comes with the sort, and the offsets are sums over one row per range.
* *NTILE*: a tile follows from at most ``tiles - 1`` boundary keys, so only those are looked for.  Each
  search keeps a bracket of keys around its rank and narrows it by a bounded sample and an exact count,
  until few enough keys are left to be read and sorted.  Then tiles are plain comparisons: no window,
  no shuffle, whatever the number of rows.

The order must be total for a repeatable result (end it with a unique column).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, StructType, TimestampNTZType

from cohortcart.session import cluster_parallelism, stored

Order = Sequence[tuple[str, bool]]      # (column, ascending)

ROWS_PER_RANGE = 2_000_000
LEAST_ROWS_PER_RANGE = 10_000           # no more ranges than cores while ranges are smaller than this
SELECT_ROWS = 20_000                    # keys of one bracket that are read and sorted on the driver


# -- row numbers --------------------------------------------------------------------------------

def range_count(n: int, parallelism: int = 1, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Ranges for ``n`` rows: each at most ``rows_per_range``, and all cores busy once rows suffice."""
    return max(1, math.ceil(n / rows_per_range), min(parallelism, math.ceil(n / LEAST_ROWS_PER_RANGE)))


def global_row_number(df: DataFrame, order: Order, out: str = "row_number", n: int | None = None,
                      ranges: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the 1-based position of each row in ``order`` (asc NULLS FIRST, desc NULLS LAST).

    ``n``: the number of rows or a bound of it, counted if not given; it only sets the number of
    ranges.  Runs a job: the sorted rows are stored under the shared checkpoint folder."""
    if ranges is None:
        ranges = range_count(df.count() if n is None else n, cluster_parallelism(df.sparkSession), rows_per_range)
    by = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    # the id Spark gives a row of a task: the task's number above bit 33, the row's place in it below
    placed = stored(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
                    .withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")     # one row per range
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select(*df.columns, number.alias(out))


# -- boundary keys and tiles --------------------------------------------------------------------

def sort_key(df: DataFrame, order: Order) -> Column:
    """One ascending struct that sorts like ``ORDER BY`` (asc NULLS FIRST, desc NULLS LAST)."""
    fields = []
    for i, (name, ascending) in enumerate(order):
        c = F.col(name)
        if ascending:
            fields += [c.isNotNull().alias(f"n{i}"), c.alias(f"v{i}")]
            continue
        dtype = df.schema[name].dataType
        if isinstance(dtype, DateType):
            value = -F.unix_date(c)
        elif isinstance(dtype, NumericType):
            value = -c
        else:
            raise TypeError(f"descending order on {dtype.simpleString()} is not supported: {name}")
        fields += [c.isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*fields)


def _sql_literal(value, dtype) -> str:
    """A typed SQL literal for one field of a key."""
    t = dtype.simpleString()
    if value is None:
        return f"CAST(NULL AS {t})"
    if isinstance(dtype, BooleanType):
        return "TRUE" if value else "FALSE"
    if isinstance(dtype, StringType):
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(dtype, DateType):
        return f"DATE '{value.isoformat()}'"
    if isinstance(dtype, TimestampNTZType):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(dtype, NumericType):
        return f"CAST('{value}' AS {t})"
    raise TypeError(f"unsupported sort key type {t}")


def _literal(key: dict, struct_type: StructType) -> Column:
    return F.expr("named_struct(" + ", ".join(f"'{f.name}', {_sql_literal(key[f.name], f.dataType)}"
                                              for f in struct_type.fields) + ")")


def _python_order(key: dict) -> tuple:
    """Orders collected keys as Spark does (a field is NULL only when its NULL flag, compared first, is
    equal on both sides)."""
    return tuple((0,) if v is None else (1, v) for v in key.values())


@dataclass
class _Search:
    """Where one boundary is: the key of ``rank`` lies above ``low`` and at or below ``high``."""

    name: str
    rank: int
    below: int              # rows at or below ``low``
    upto: int               # rows at or below ``high``
    low: dict | None = None
    high: dict | None = None

    def holds(self, key: Column, kind: StructType) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (key > _literal(self.low, kind))
        if self.high is not None:
            inside = inside & (key <= _literal(self.high, kind))
        return inside

    def holds_collected(self, key: dict) -> bool:
        if self.low is None and self.high is None:
            return True
        at = _python_order(key)
        return ((self.low is None or at > _python_order(self.low))
                and (self.high is None or at <= _python_order(self.high)))


def boundary_keys(df: DataFrame, orders: dict[str, Order], ranks: Sequence[int], n: int,
                  select_rows: int = SELECT_ROWS, seed: int = 17) -> dict[str, list[dict]]:
    """For each order the sort keys of the rows at the given 1-based ``ranks``.

    Every round is two jobs over the keys for all open searches of about one size; a round shrinks a
    bracket to about ``4 / sqrt(select_rows)`` of its rows, or to half near its ends.  About
    ``select_rows`` keys per search are read at once."""
    keys = df.select(*[sort_key(df, o).alias(name) for name, o in orders.items()])
    kinds = {name: keys.schema[name].dataType for name in orders}
    searches = [_Search(name, r, 0, n) for name in orders for r in ranks]
    found: dict[tuple[str, int], dict] = {}

    def read(group: list[_Search], fraction: float | None, seed: int = 0) -> list[list[dict]]:
        """Per search the keys (or a sample of them) in its bracket, sorted."""
        some = keys if fraction is None else keys.sample(False, fraction, seed)
        wanted = F.lit(False)
        for s in group:
            wanted = wanted | s.holds(F.col(s.name), kinds[s.name])
        rows = some.where(wanted).toArrow().to_pylist()
        by_bracket: dict[str, list[dict]] = {}             # searches that share a bracket share its keys
        out = []
        for s in group:
            bracket = f"{s.name} {s.low} {s.high}"
            if bracket not in by_bracket:
                by_bracket[bracket] = sorted((r[s.name] for r in rows if s.holds_collected(r[s.name])),
                                             key=_python_order)
            out.append(by_bracket[bracket])
        return out

    idle = 0
    while searches:
        ready = [s for s in searches if s.upto - s.below <= select_rows]
        if ready:
            for s, inside in zip(ready, read(ready, None), strict=True):
                found[s.name, s.rank] = inside[s.rank - s.below - 1]
        searches = [s for s in searches if s.upto - s.below > select_rows]
        if not searches:
            break
        # one sample serves searches of about the same size; each round takes the largest
        largest = max(s.upto - s.below for s in searches)
        group = [s for s in searches if s.upto - s.below > largest / 8]
        tries = []
        for s, inside in zip(group, read(group, min(1.0, max(select_rows, 64) / largest), seed), strict=True):
            at = (s.rank - s.below) / (s.upto - s.below) * len(inside)
            margin = 2 * math.sqrt(len(inside)) + 1
            # around the rank, and the middle, which halves the bracket when the rank lies near an end
            places = {int(at - margin), int(at + margin), len(inside) // 2}
            tries.append([inside[i] for i in sorted(places) if 0 <= i < len(inside)])
        counted = [F.count_if(F.col(s.name) <= _literal(key, kinds[s.name])).alias(f"c{i}_{j}")
                   for i, (s, some) in enumerate(zip(group, tries, strict=True)) for j, key in enumerate(some)]
        counts = keys.agg(F.count(F.lit(1)), *counted).first()
        before = [(s.below, s.upto) for s in searches]
        for i, (s, some) in enumerate(zip(group, tries, strict=True)):
            for j, key in enumerate(some):
                upto = counts[f"c{i}_{j}"]
                if s.below < upto < s.rank:
                    s.low, s.below = key, upto
                elif s.rank <= upto < s.upto:
                    s.high, s.upto = key, upto
        seed += 1
        idle = idle + 1 if before == [(s.below, s.upto) for s in searches] else 0
        if idle >= 8:
            raise ValueError("the order is not total: more equal keys than a bracket may hold")
    return {name: [found[name, r] for r in ranks] for name in orders}


def ntiles(df: DataFrame, tiles: int, orders: dict[str, Order], n: int | None = None,
           select_rows: int = SELECT_ROWS) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY order)`` for each entry of ``orders`` (name -> order): the first
    ``n % tiles`` tiles hold one row more.  ``df`` is read several times: store it first."""
    n = df.count() if n is None else n
    q, r = divmod(n, tiles)
    ends = [t * q + min(t, r) for t in range(1, tiles)]
    ends = [e for e in dict.fromkeys(ends) if 0 < e < n]       # last rank of each tile but the last
    bounds = boundary_keys(df, orders, ends, n, select_rows) if ends else {name: [] for name in orders}
    tile_of = {e: t for t in range(tiles - 1, 0, -1) for e in [t * q + min(t, r)] if e in ends}
    last_tile = tiles if q else max(r, 1)
    columns = []
    for name, order in orders.items():
        key = sort_key(df, order)
        kind = df.select(key.alias("k")).schema["k"].dataType
        tile = F.lit(last_tile)
        for end, bound in reversed(list(zip(ends, bounds[name], strict=True))):
            tile = F.when(key <= _literal(bound, kind), F.lit(tile_of[end])).otherwise(tile)
        columns.append(tile.cast("int").alias(name))
    return df.select(*df.columns, *columns)


def ntile(df: DataFrame, tiles: int, order: Order, out: str, **options) -> DataFrame:
    """``ntiles`` for one order."""
    return ntiles(df, tiles, {out: order}, **options)
