"""The stored basket roll-up: equal reports, refresh of changed months only, odd lines, plan shape."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortcart.operators import baskets as BK
from cohortcart.operators import rfm as RFM
from cohortcart.operators import sales as S
from cohortcart.plans import basket_store as store
from cohortcart.plans.inspect import plan_text
from cohortcart.session import scratch_path
from cohortcart.sources.tables import TRANSACTIONS_SCHEMA

AS_OF = "2002-01-01"
REPORTS = [
    (S.monthly_trend, BK.monthly_trend, ()), (S.country_sales, BK.country_sales, ()),
    (S.customer_behaviour, BK.customer_behaviour, ()), (RFM.rfm_values, BK.rfm_values, (AS_OF,)),
    (RFM.rfm_scores, BK.rfm_scores, (AS_OF,)), (RFM.sales_segments, BK.sales_segments, ()),
]


def line(invoice, customer, day, country="UK", quantity=1, total="1.50", hour=9):
    when = dt.datetime(*day, hour) if day else None
    money = Decimal(total) if total is not None else None
    return (invoice, "P", None, quantity, when, None, customer, country, money)


LINES = [
    line("a", 1, (2001, 1, 5)), line("a", 1, (2001, 1, 5), hour=23), line("a", 1, (2001, 1, 5), quantity=-1, total="-1.50"),
    line("a", 2, (2001, 1, 31)), line("b", 2, (2001, 2, 1), country=None), line("b", 2, (2001, 2, 1), total=None),
    line(None, 3, (2001, 2, 3)), line(None, 3, (2001, 12, 31), quantity=None), line("c", None, (2001, 2, 3)),
    line("d", 4, None), line("e", 5, (2001, 2, 9), quantity=-2, total="-7"), line("e", 5, (2001, 2, 9), quantity=0),
    line("f", 6, (2002, 1, 1), total="900"), line("f", 6, (2002, 1, 1), total="900"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, TRANSACTIONS_SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def assert_same_reports(lines, baskets):
    for over_lines, over_baskets, args in REPORTS:
        a, b = over_lines(lines, *args), over_baskets(baskets, *args)
        assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
        assert rows(a) == rows(b), over_lines.__name__


def assert_up_to_date(lines, baskets):
    assert rows(baskets) == rows(BK.roll_up(lines))


@pytest.fixture()
def location(spark):
    return scratch_path(spark, "baskets-test")


def test_reports_equal_those_over_lines(spark, location):
    lines = frame(spark, LINES)
    assert store.refresh(lines, location) == [0, 200101, 200102, 200112, 200201]
    assert_same_reports(lines, store.read(spark, location))


def test_only_changed_months_are_written(spark, location):
    store.refresh(frame(spark, LINES), location)
    assert store.refresh(frame(spark, LINES), location) == []
    before, _ = store._ledger(spark, location)
    more = [*LINES, line("g", 1, (2001, 2, 28))]
    assert store.refresh(frame(spark, more), location) == [200102]
    after, _ = store._ledger(spark, location)
    assert {m for m in after if after[m] != before[m]} == {200102}
    assert_up_to_date(frame(spark, more), store.read(spark, location))


@pytest.mark.parametrize("change", [
    lambda r: r[:-1],                                                         # one of two equal lines goes
    lambda r: [*r[:-1], line("f", 6, (2002, 1, 1), total="901")],             # an amount is corrected
    lambda r: [x for x in r if x[4] is None or x[4].year != 2002],            # a month is emptied
    lambda r: [x for x in r if x[4] is not None],                             # the lines without a date go
    lambda r: [],
])
def test_removed_and_altered_lines(spark, location, change):
    store.refresh(frame(spark, LINES), location)
    now = frame(spark, change(LINES))
    assert store.refresh(now, location)
    assert_up_to_date(now, store.read(spark, location))
    assert store.refresh(now, location) == []


def test_named_months_read_no_other_lines(spark, location):
    store.refresh(frame(spark, LINES), location)
    more = [*LINES, line("g", 1, (2001, 1, 28)), line("h", 1, (2001, 12, 1)), line("i", 9, (2001, 2, 1))]
    assert store.refresh(frame(spark, more), location, months=[200101, 200112]) == [200101, 200112]
    assert_up_to_date(frame(spark, more[:-1]), store.read(spark, location))
    only = store.read(spark, location, months=[200112])
    assert {r["day"] for r in only.collect()} == {dt.date(2001, 12, 31), dt.date(2001, 12, 1)}


def test_empty_table_and_late_first_lines(spark, location):
    nothing = frame(spark, [])
    assert store.refresh(nothing, location) == []
    assert store.read(spark, location).count() == 0
    assert_same_reports(nothing, store.read(spark, location))
    store.refresh(frame(spark, LINES), location)
    assert_up_to_date(frame(spark, LINES), store.read(spark, location))


def test_extra_and_clashing_columns_are_ignored(spark, location):
    lines = frame(spark, LINES).withColumn("month", F.lit("x")).withColumn("day", F.lit("y")).withColumn("mark", F.lit(1))
    store.refresh(lines, location)
    assert_up_to_date(frame(spark, LINES), store.read(spark, location))


def test_a_refresh_that_died_before_its_ledger_rows_is_not_seen(spark, location):
    store.refresh(frame(spark, LINES), location)
    lost = BK.roll_up(frame(spark, LINES)).withColumn("month", BK.month_number(F.col("day")))
    lost.write.partitionBy("month").parquet(f"{location}/baskets/lost")
    assert_up_to_date(frame(spark, LINES), store.read(spark, location))


def test_a_hot_customer_is_combined_before_the_shuffle(spark, location):
    many = spark.range(20_000).select(F.lit("a").alias("InvoiceNo"), F.lit(1).cast("int").alias("Quantity"),
                                      F.lit("2001-01-05 10:00:00").cast("timestamp_ntz").alias("InvoiceDate"),
                                      F.lit(7).cast("bigint").alias("CustomerID"), F.lit("UK").alias("Country"),
                                      F.lit("0.25").cast("decimal(18,5)").alias("Total_Sales"))
    p = plan_text(BK.roll_up(many))
    assert p.count("HashAggregate") == 2 and "SortAggregate" not in p and p.count("Exchange") == 1
    store.refresh(many, location)
    only = store.read(spark, location).collect()
    assert len(only) == 1 and only[0]["lines"] == 20_000 and only[0]["sales"] == 5000


def test_month_ranges_reach_the_scan(spark, location):
    path = scratch_path(spark, "lines")
    frame(spark, LINES).write.parquet(path)
    some = spark.read.parquet(path).where(store.in_months([200112, 200201, 200105]))
    pushed = [x for x in plan_text(some, "formatted").split("\n") if x.startswith("PushedFilters")][0]
    assert pushed.count("GreaterThanOrEqual(InvoiceDate") == 2          # December and January are one run
    assert {r["InvoiceDate"].month for r in some.collect()} == {12, 1}


def test_reports_read_baskets_only(spark, location):
    store.refresh(frame(spark, LINES), location)
    p = plan_text(BK.rfm_values(store.read(spark, location), AS_OF))
    assert p.count("FileScan") == 1 and "Total_Sales" not in p and "Join" not in p
