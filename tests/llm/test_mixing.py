import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortcart.llm.mixing import fit_mixture, mixed, with_copies, with_targets
from tests.llm import odd


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def target_words(sizes, weights=(5, 2, 1), cap=3):
    """The targets, source by source."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while True:
        share = left / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if weight[s] * share > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, "d": 100, None: 1}, {"a": 0, None: 0}, {f"s{i}": (i * 37) % 101 for i in range(60)}, {}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, words long, docs long")
    got = {r["source"]: r["target"] for r in with_targets(rows).collect()}
    assert got == pytest.approx(target_words(sizes))


def hot_rows(spark, equal, others):
    """One source of which ``equal`` rows are the same in every column, and three others."""
    text = "w " * 33
    rows = [(7, text, "en", "a", 1)] * equal + [(1000 + i, f"v{i} " * (5 + i % 60), "en", "a", 1) for i in range(others)]
    rows += [(5000 + i, "x " * (10 + i % 50), "en", f"b{i % 3}", 1) for i in range(900)]
    return spark.createDataFrame(rows, odd.SCHEMA)


@pytest.mark.parametrize("equal, others", [(600, 300), (2000, 0)])
def test_equal_rows_are_shared_out(spark, equal, others):
    docs = hot_rows(spark, equal, others)
    runs = []
    for d in (docs, docs.repartition(5)):
        rows = with_copies(d, fit_mixture(d)).collect()
        assert len(rows) == docs.count()
        runs.append(sorted(odd.key((r["doc"]["doc_id"], r["size"], r["copies"])) for r in rows))
        taken, target = Counter(), {}
        for r in rows:
            taken[r["doc"]["source"]] += r["size"] * r["copies"]
            target[r["doc"]["source"]] = r["target"]
        for s, t in target.items():
            assert taken[s] == pytest.approx(t, rel=0.01), s
    assert runs[0] == runs[1]
    assert len({r["copies"] for r in rows if r["doc"]["doc_id"] == 7}) <= 2


def test_many_sources(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "repeat('w ', 3 + int(id % 7)) AS text", "'en' AS lang",
                                          "concat('host', id % 20000) AS source", "1L AS n_chars")
    rows = with_copies(docs, fit_mixture(docs))
    row = rows.selectExpr("doc.source AS s", "size * copies AS t", "target", "copies").groupBy("s").agg(
        F.sum("t").alias("t"), F.first("target").alias("target"), F.max("copies").alias("c")).agg(
        F.count("s"), F.sum("t"), F.sum("target"), F.max("c")).first()
    assert row[0] == 20_000 and row[1] == pytest.approx(row[2], rel=0.05) and row[3] <= 3


def test_taken_words_near_targets_caps_and_reruns(spark):
    docs = odd.documents(spark, clash=True)
    runs = []
    for d in (docs, docs.repartition(7)):
        rows = with_copies(d, fit_mixture(d)).collect()
        runs.append(sorted(odd.key((r["doc"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]))
                           for r in rows))
    assert runs[0] == runs[1]
    sizes = Counter()
    for r in odd.rows():
        sizes[r[3]] += n_words(r[1])
    want = target_words(dict(sizes))
    taken, units = Counter(), {}
    for r in rows:
        assert r["size"] == n_words(r["doc"]["text"]) and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["doc"]["source"]]
        assert r["target"] == pytest.approx(want[r["doc"]["source"]])
        assert r["size"] or not r["copies"]
        taken[r["doc"]["source"]] += r["copies"] * r["size"]
        units.setdefault(r["doc"]["source"], Counter())[(r["doc"]["doc_id"], r["doc"]["text"])] += r["size"]
    for s in ("s0", "s1", "s2", "hot"):
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], max(units[s].values())), s


def test_mix_repeats_rows_with_their_columns(spark):
    docs = odd.documents(spark, clash=True)
    mix = fit_mixture(docs)
    out = mixed(docs, mix)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in with_copies(docs, mix).collect())


def test_empty_table(spark):
    docs = odd.empty(spark)
    assert with_copies(docs, fit_mixture(docs)).count() == 0


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op4_mixing, table

    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    sizes, taken = Counter(), Counter()
    for r in docs.values():
        sizes[r["source"]] += n_words(r["text"])
    want = target_words(dict(sizes))
    rows = op4_mixing(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == n_words(docs[r["doc_id"]]["text"]) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
