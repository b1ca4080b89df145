"""Sharding: a global shuffle of records into equal shards, in two passes.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of their row key.
Pass two brings each bucket into one task's memory, shuffles it with Fisher-Yates (seeded by the
bucket) and writes it.  Bucket counts, summed in bucket order, give every record a global
position; positions are dealt to shards in equal runs, so shard counts differ by one at most
(law ``rows``) and slots have no gaps.

The row key decides the bucket, so give columns that tell rows apart: ``documents`` uses the id
with the stored row's file and place in it, and thus even one id on a third of all rows is spread
evenly.  Each bucket is sorted by hashes of the key and the whole record before it is shuffled, so
a re-run task deals the same slots.  Buckets are sized by whole records, all columns; the table of
bucket offsets (one row per bucket) is joined as Spark sees fit, not forced on all tasks.

Defined cases: null text counts one byte (size) and has checksum 0; empty texts are records like
any other; a very long text is one record of its bucket, which is then larger by it; repeated rows
are separate records, and ties of the key are ordered by the whole record; fewer records than shards leave shards empty; an
empty table gives no rows.  Records travel as one struct, so no column name can clash.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructType

LAW = "rows"
BUCKET_BYTES = 24 << 20


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_size(docs: DataFrame) -> Column:
    """About the bytes of a whole row: texts by their length, nested columns by their JSON."""
    def size(field) -> Column:
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 4
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        return F.lit(8)

    return reduce(add, [size(f).cast("long") for f in docs.schema.fields])


def shuffled_buckets(rows: DataFrame, seed: int) -> DataFrame:
    """``record, bucket, place``: each bucket's records in Fisher-Yates order, ``place`` from 0."""
    record_type = rows.schema["record"].dataType

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("key", "ascending"), ("tie", "ascending")])
        number = bucket.column("bucket")[0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, number])).permutation(bucket.num_rows)
        dealt = bucket.select(["record", "bucket"]).take(pa.array(order))
        return dealt.append_column("place", pa.array(np.arange(bucket.num_rows, dtype=np.int64)))

    schema = StructType().add("record", record_type).add("bucket", LongType()).add("place", LongType())
    return rows.groupBy("bucket").applyInArrow(fisher_yates, schema)


def write_shards(docs: DataFrame, path: str, shards: int, row_key: list[Column],
                 seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` to ``path`` as parquet folders ``shard=0 ...`` and returns the written table:
    ``record`` (struct of all columns), ``slot``, ``shard``."""
    spark = docs.sparkSession
    total, n = docs.agg(F.sum(record_size(docs)), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), *row_key)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("record"), key.alias("key"))
    rows = rows.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    bases = counts.select("bucket", (F.sum("rows").over(Window.orderBy("bucket")) - F.col("rows")).alias("base"))
    rows = rows.withColumn("tie", F.xxhash64(*[F.col("record")[c] for c in names]))
    placed = (shuffled_buckets(rows, seed).join(bases, "bucket")
              .withColumn("at", F.col("base") + F.col("place")))
    small, larger = n // shards, n % shards        # the first `larger` shards get one record more
    edge, each = larger * (small + 1), max(small, 1)
    dealt = placed.select(
        "record",
        F.when(F.col("at") < edge, F.col("at") % (small + 1)).otherwise((F.col("at") - edge) % each).alias("slot"),
        F.when(F.col("at") < edge, F.expr(f"at div {small + 1}"))
        .otherwise(F.expr(f"{larger} + (at - {edge}) div {each}")).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)
