"""Global order by counting: same order as ``orderBy``, even partitions, odd keys and ties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortcart.operators import placing
from cohortcart.operators.placing import order_by_counts

LONG = st.one_of(st.none(), st.sampled_from([-(1 << 63), (1 << 63) - 1, 0, -1]), st.integers(-50, 50))


def in_order(df):
    return [tuple(r) for r in df.collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), LONG), max_size=40), st.booleans())
def test_same_order_as_order_by(spark, rows, ascending):
    df = spark.createDataFrame(rows, "k int, t bigint").repartition(3)
    want = df.orderBy(F.asc("k") if ascending else F.desc("k"), F.asc("t"))
    assert in_order(order_by_counts(df, "k", "t", ascending)) == in_order(want)


@pytest.mark.parametrize("tie", ["id", "xxhash64(id)"])
def test_one_key_is_split_evenly(spark, tie):
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.expr(tie).alias("t"))
    out = order_by_counts(df, "k", "t", rows_per_partition=2_000)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 2_000


def test_hot_key_among_others(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 40).cast("int")).alias("k"),
                                    F.col("id").alias("t"))
    out = order_by_counts(df, "k", "t", ascending=False, rows_per_partition=1_500)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 1_500
    assert in_order(out) == in_order(df.orderBy(F.desc("k"), F.asc("t")))


def test_many_keys_fall_back_to_spark(spark, monkeypatch):
    monkeypatch.setattr(placing, "MAX_CELLS", 10)
    df = spark.range(500).select(F.col("id").alias("k"), (-F.col("id")).alias("t"))
    assert in_order(order_by_counts(df, "k", "t")) == in_order(df.orderBy("k", "t"))


def test_the_input_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = spark.range(1_000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t")).mapInArrow(touch, "k bigint, t bigint")
    order_by_counts(df, "k", "t").collect()
    assert ran.value == 1_000


def test_clashing_columns(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.lit("x").alias("n"), F.lit(2).alias("month"))
    out = order_by_counts(df, "k", "t")
    assert out.columns == df.columns and in_order(out) == in_order(df.orderBy("k", "t"))
