"""The distributed global row number and NTILE against brute force."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortcart.operators.ranking import boundary_keys, global_row_number, ntile, ntiles, range_count


def brute_ntile(values, tiles):
    n = len(values)
    q, r = divmod(n, tiles)
    out = []
    for t in range(tiles):
        out += [t + 1] * (q + (1 if t < r else 0))
    return out


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key value; some keys are NULL."""
    return spark.range(6000).select(
        F.col("id").alias("cid"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None))
         .otherwise(F.col("id") * 37 % 1000).cast("long").alias("k"),
        (F.col("id") % 13).cast("decimal(10,2)").alias("m"))


@pytest.mark.parametrize("ascending", [True, False])
def test_row_number_matches_pandas_sort(spark, skewed, ascending):
    got = global_row_number(skewed, [("k", ascending), ("cid", True)], "rn", ranges=16)
    got = got.select("cid", "rn").toPandas().sort_values("rn")
    pdf = skewed.toPandas()
    pdf = pdf.sort_values(["k", "cid"], ascending=[ascending, True], na_position="first" if ascending else "last")
    assert got["rn"].tolist() == list(range(1, 6001))
    assert got["cid"].tolist() == pdf["cid"].tolist()


def test_a_thousand_ranges(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = global_row_number(skewed, [("m", True), ("cid", True)], "rn", ranges=1000).select("cid", "rn").toPandas()
    want = skewed.toPandas().sort_values(["m", "cid"])["cid"].tolist()
    assert got.sort_values("rn")["cid"].tolist() == want and got["rn"].is_unique
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_range_count_has_no_cap():
    assert range_count(0, 8) == 1
    assert range_count(9_999, 8) == 1
    assert range_count(150_000, 8) == 8
    assert range_count(100_000_000, 8) == 50
    assert range_count(10**12, 8000) == 500_000
    assert range_count(15_000, 1, rows_per_range=1000) == 15


def test_row_number_of_an_empty_table(spark, skewed):
    assert global_row_number(skewed.where("cid < 0"), [("cid", True)], "rn").count() == 0


@pytest.mark.parametrize("select_rows", [40, 300, 20_000])
def test_ntile_matches_brute_force(spark, skewed, select_rows):
    out = ntile(skewed, 5, [("m", False), ("cid", True)], "t", select_rows=select_rows).toPandas()
    pdf = skewed.toPandas().sort_values(["m", "cid"], ascending=[False, True], na_position="last")
    expected = pd.Series(brute_ntile(pdf, 5), index=pdf["cid"].values)
    assert (out.set_index("cid")["t"].sort_index() == expected.sort_index()).all()


def test_boundary_search_narrows_to_any_rank(spark, skewed):
    want = skewed.toPandas().sort_values(["k", "cid"], na_position="first")["cid"].tolist()
    ranks = [1, 2, 999, 3000, 5999, 6000]
    found = boundary_keys(skewed, {"o": [("k", True), ("cid", True)]}, ranks, 6000, select_rows=50)["o"]
    assert [key["v1"] for key in found] == [want[r - 1] for r in ranks]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=0, max_size=60),
       tiles=st.integers(1, 7), select_rows=st.integers(4, 20), ascending=st.booleans())
def test_ntile_is_exact_for_any_bracket(spark, values, tiles, select_rows, ascending):
    """Whatever the ties, NULLs and sample sizes, NTILE equals the brute force."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "cid long, k int")
    got = {r["cid"]: r["t"] for r in ntile(df, tiles, [("k", ascending), ("cid", True)], "t",
                                           select_rows=select_rows).collect()}
    nulls = [r for r in rows if r[1] is None]
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1] if ascending else -r[1], r[0]))
    order = (nulls + known) if ascending else (known + nulls)
    assert got == dict(zip([r[0] for r in order], brute_ntile(order, tiles)))


def test_string_and_date_keys_with_awkward_values(spark):
    """Boundary keys are rendered as SQL literals: quotes, backslashes, NULLs and dates must survive."""
    names = ["O'Brien", "back\\slash", "plain", None, "ünïcode", "a'b\\'c", "zz"]
    rows = [(i, names[i % len(names)], dt.date(2000, 1, 1) + dt.timedelta(days=i % 37)) for i in range(700)]
    df = spark.createDataFrame(rows, "cid long, name string, day date")
    order = [("name", True), ("day", False), ("cid", True)]
    pdf = df.toPandas()
    pdf["null_name"] = pdf["name"].isna()
    pdf["day_key"] = pdf["day"].map(lambda d: -d.toordinal())
    # NULL names first (ascending), then names in byte order, days descending, cid ascending
    pdf["name_bytes"] = pdf["name"].map(lambda x: x.encode() if x is not None else b"")
    pdf = pdf.sort_values(["null_name", "name_bytes", "day_key", "cid"], ascending=[False, True, True, True])
    ranked = global_row_number(df, order, "rn", ranges=9).toPandas().sort_values("rn")
    assert ranked["cid"].tolist() == pdf["cid"].tolist()
    tiles = ntiles(df, 7, {"t": order}, select_rows=30).toPandas().set_index("cid")["t"]
    assert tiles.loc[pdf["cid"]].tolist() == brute_ntile(pdf, 7)
