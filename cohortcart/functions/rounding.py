"""Exact half-up rounding of ratios and averages, identical in Spark and in plain SQL.

Doubles are never rounded here: ``round(0.575D, 2)`` differs between engines on
exact ties, so every ratio is computed as an integer division first.  Each Spark
builder has a SQL twin (``*_sql``) used by the oracle queries; both must agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``): truncates toward zero, exact for longs and decimals."""
    return F.call_function("div", a, b)


def pct_half_up(hits: Column, n: Column, places: int = 2) -> Column:
    """``round(hits / n * 100, places)`` half-up, as DOUBLE; hits and n are non-negative counts."""
    scale = 10 ** places
    q = idiv(hits * (200 * scale) + n, F.nullif(n * 2, F.lit(0)))
    return q.cast("double") / scale


def pct_half_up_int(hits: Column, n: Column) -> Column:
    """``CAST(ROUND(hits * 100.0 / n, 0) AS INT)`` half-up."""
    return idiv(hits * 200 + n, F.nullif(n * 2, F.lit(0))).cast("int")


def pct_half_up_decimal(hits: Column, n: Column, precision: int = 5, places: int = 2) -> Column:
    """``CAST(hits * 100.0 / n AS DECIMAL(precision, places))`` half-up."""
    scale = 10 ** places
    q = idiv(hits * (200 * scale) + n, F.nullif(n * 2, F.lit(0)))
    return (q.cast("decimal(18,0)") * F.lit(f"{1 / scale:.{places}f}").cast(f"decimal({places + 1},{places})")) \
        .cast(f"decimal({precision},{places})")


def avg_half_up(total: Column, n: Column, places: int = 6, precision: int = 38) -> Column:
    """``total / n`` rounded half away from zero to ``places`` decimals, exactly.

    ``total`` is a DECIMAL sum and ``n`` the count of the summed values, so this is
    ``AVG`` with the result scale of an integer-exact decimal average.
    """
    scale = 10 ** places
    sign = F.when(total < 0, F.lit(-1)).otherwise(F.lit(1))
    q = idiv(F.abs(total) * (2 * scale) + n, F.nullif(n * 2, F.lit(0)))
    return ((sign * q).cast("decimal(38,0)")
            * F.lit(f"{1 / scale:.{places}f}").cast(f"decimal({places + 1},{places})")) \
        .cast(f"decimal({precision},{places})")


def int_avg(total: Column, n: Column) -> Column:
    """Integer ``AVG`` of an integer column: truncates toward zero, as in integer arithmetic."""
    return idiv(total, F.nullif(n, F.lit(0))).cast("int")


# ---- SQL twins (DuckDB dialect: `//` is integer division) -------------------------------

def pct_half_up_sql(hits: str, n: str, places: int = 2) -> str:
    scale = 10 ** places
    return (f"(CAST((CAST({hits} AS BIGINT) * {200 * scale} + {n}) // NULLIF(2 * {n}, 0) AS DOUBLE)"
            f" / {scale})")


def pct_half_up_int_sql(hits: str, n: str) -> str:
    return f"CAST((CAST({hits} AS BIGINT) * 200 + {n}) // NULLIF(2 * {n}, 0) AS INTEGER)"


def pct_half_up_decimal_sql(hits: str, n: str, precision: int = 5, places: int = 2) -> str:
    scale = 10 ** places
    q = f"((CAST({hits} AS BIGINT) * {200 * scale} + {n}) // NULLIF(2 * {n}, 0))"
    return (f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST({1 / scale:.{places}f} AS DECIMAL({places + 1},{places}))"
            f" AS DECIMAL({precision},{places}))")


def avg_half_up_sql(total: str, n: str, places: int = 6, precision: int = 38) -> str:
    """``total`` must have at most ``places`` decimals so that ``|total| * 10^places`` is integral."""
    scale = 10 ** places
    q = f"((CAST(ABS({total}) * {2 * scale} AS HUGEINT) + {n}) // NULLIF(2 * {n}, 0))"
    return (f"CAST(CAST(SIGN({total}) * {q} AS DECIMAL(38,0))"
            f" * CAST({1 / scale:.{places}f} AS DECIMAL({places + 1},{places})) AS DECIMAL({precision},{places}))")


def int_avg_sql(total: str, n: str) -> str:
    return f"CAST(CAST({total} AS BIGINT) // NULLIF({n}, 0) AS INTEGER)"
