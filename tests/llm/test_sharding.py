import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortcart.llm.sharding import write_shards
from tests.llm import odd


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 24])
def test_counts_slots_and_whole_records(spark, tmp_location, bucket_bytes):
    docs = odd.documents(spark, clash=True)
    out = write_shards(docs, f"{tmp_location}/{bucket_bytes}", 7, [F.col("doc_id"), F.col("text")],
                       bucket_bytes=bucket_bytes).collect()
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    assert sorted(odd.key(r["record"]) for r in out) == sorted(odd.key(r) for r in docs.collect())


def test_reruns_agree_and_order_is_shuffled(spark, tmp_location):
    docs = odd.documents(spark).where("doc_id < 60").dropDuplicates(["doc_id"])
    runs = [[(r["record"]["doc_id"], r["shard"], r["slot"]) for r in write_shards(
        docs.repartition(k), f"{tmp_location}/{k}", 1, [F.col("doc_id")]).collect()] for k in (2, 5)]
    assert sorted(runs[0]) == sorted(runs[1])
    order = [d for d, _, _ in sorted(runs[0], key=lambda r: r[2])]
    assert order != sorted(order)


def test_few_and_no_records(spark, tmp_location):
    few = odd.documents(spark).where("doc_id in (100, 101)")
    assert sorted(r["slot"] for r in write_shards(few, f"{tmp_location}/few", 16, [F.col("doc_id")]).collect()) == [0, 0]
    assert write_shards(odd.empty(spark), f"{tmp_location}/none", 16, [F.col("doc_id")]).count() == 0


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op3_sharding, table

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    out = op3_sharding(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {
        k: (len(v) + 1, zlib.crc32(v)) for k, v in texts.items()}
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(texts) and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
