import random

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from cohortcart.llm import components as C
from cohortcart.llm import simhash
from cohortcart.llm.components import components
from tests.llm import odd


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict, max_bits=3):
    """Smallest key reachable from each key."""
    keys, name = sorted(fps), {}
    for k in keys:
        if k in name:
            continue
        todo = [k]
        name[k] = k
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in name and (fps[x] ^ fps[y]).bit_count() <= max_bits:
                    name[y] = k
                    todo.append(y)
    return name


def test_fingerprint_of_odd_and_cut_texts(monkeypatch):
    texts = [r[1] for r in odd.rows()]
    assert [simhash.fingerprint((t or "").encode()) for t in texts if len(t or "") < 9000] == [
        plain_fingerprint(t) for t in texts if len(t or "") < 9000]
    whole = simhash.fingerprint(texts[9].encode())
    monkeypatch.setattr(simhash, "SEGMENT_BYTES", 17)
    assert simhash.fingerprint(texts[9].encode()) == whole


@pytest.mark.parametrize("fixed", [0, 0xFFFFFFFF00000000, (1 << 60) - 1])
def test_masks_cover_every_pair_within_the_radius(fixed):
    masks = simhash.covering_masks(3, fixed)
    rng, free = random.Random(1), [b for b in range(64) if not fixed >> b & 1]
    for _ in range(4000):
        flips = sum(1 << b for b in rng.sample(free, min(3, len(free))))
        assert any(m & flips == 0 for m in masks)
    assert all(m & fixed == fixed for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (-7, -9), (-9, -7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in range(1, 201)} == {0}
    assert {found[1000 + i] for i in range(1, 50)} == {1000} and found[-7] == -9
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_in_crowded_buckets_lose_nothing(spark):
    """Clusters so dense that the buckets are dealt again, against comparing all pairs."""
    rng, fps = random.Random(9), set()
    for centre in (0, rng.getrandbits(64)):
        for _ in range(700):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    want = plain_components({f: f & (1 << 64) - 1 for f in signed})
    groups, expected = {}, {}
    for f in signed:
        groups.setdefault(found.get(f, f), set()).add(f)
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_odd_documents(spark):
    rows = [r for r in odd.rows() if r[0] not in (106, 107)]
    docs = odd.documents(spark, clash=True).where("doc_id is null or doc_id not in (106, 107)")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = {}
    for r in rows:
        fps.setdefault((r[0] is None, r[0] if r[0] is not None else r[1] or ""), plain_fingerprint(r[1]))
    names = plain_components({k: v for k, v in fps.items() if not k[0]})
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in out if r["doc_id"] is not None} == {
        k[1]: (v, names[k][1]) for k, v in fps.items() if not k[0]}
    assert all(r["component_id"] == 100 for r in out if r["fingerprint"] == "0" * 16)


def test_keep_one_of_each_group(spark):
    docs = odd.documents(spark, clash=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    named = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(named) and ids.count(None) == 1


def test_keep_one_with_repeated_and_null_ids(spark):
    """Different texts that share an id stay; equal texts without ids become one."""
    apart, also, third = (odd.prose(random.Random(k), 60, 5000) for k in (1, 2, 3))
    rows = [(1, apart, "en", "s", 1), (1, also, "en", "s", 1), (None, third, "en", "s", 1), (None, third, "de", "t", 2),
            (2, apart, "en", "s", 1), (1, apart, "en", "s", 1), (1, apart, "fr", "s", 1), (9, "", "en", "s", 1),
            (None, None, "en", "s", 1)]
    frame = spark.createDataFrame(rows, odd.SCHEMA)
    out = [sorted(map(odd.key, simhash.keep_one(frame.repartition(k)).collect())) for k in (2, 5)]
    assert out[0] == out[1]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, apart), (1, also), (None, third), (9, "")]))


def test_empty_table(spark):
    schema = StructType().add("doc_id", LongType()).add("text", StringType())
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert simhash.keep_one(odd.empty(spark)).count() == 0


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op7_simhash, table

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    fps = {k: plain_fingerprint(t) for k, t in texts.items()}
    names = plain_components(fps)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op7_simhash(spark, sf).collect()} == {
        (k, f"{fps[k]:016x}", names[k]) for k in texts}


def test_components_of_one_centre_with_most_edges(spark):
    """Half of all edges meet in one node; no key of the star steps gets more than a small share of them."""
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    top = spark.range(5000, 6000).select(F.lit(7000).cast("long").alias("u"), F.col("id").alias("v"))
    chain = spark.range(8000, 8020).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    odd = spark.createDataFrame([(9000, 9000), (9001, 9002), (9002, 9001), (9001, 9002)], "u long, v long")
    edges = star.unionByName(top).unionByName(chain).unionByName(odd)
    found = {r["node"]: r["root"] for r in C.components(edges).where("node <> root").collect()}
    expected = {v: 0 for v in range(1, 4001)} | {v: 5000 for v in [*range(5001, 6000), 7000]}
    expected |= {v: 8000 for v in range(8001, 8021)} | {9002: 9001}
    assert found == expected
    keys = C._salted(star).groupBy("u", "s").count()
    assert keys.count() == C.SALTS and keys.agg(F.max("count")).first()[0] < 4000 * 0.05
