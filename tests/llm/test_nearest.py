import math

import numpy as np
from pyspark.sql import functions as F

from cohortcart.llm.nearest import CentroidGraph, IndexSettings, balanced_centroids, nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>"


def inner(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def sound(v, d):
    return v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k, d, asked=lambda i: i % 20 == 0):
    rows = [(i, v) for i, v in rows if i is not None and sound(v, d)]
    out = {}
    for q, x in rows:
        if asked(q):
            best = {}
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), inner(x, v))
            out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, d, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(i, [float(x) for x in centres[i % 12] + spread * rng.normal(size=d)]) for i in range(n)]


def test_one_list_is_exact_with_odd_vectors(spark):
    rows = vectors(300, 5)
    rows += [(1000 + 20 * i, rows[7][1]) for i in range(60)]                # one vector many times
    rows += [(400, None), (420, [0.0] * 5), (440, [1.0, None, 0.0, 0.0, 0.0]), (460, [math.nan] * 5),
             (480, [math.inf, 0.0, 0.0, 0.0, 0.0]), (500, [1.0, 2.0]), (None, [9.0] * 5), (520, []), rows[3], rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS list", "1 AS vector", "2 AS ids")
    assert answers(nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20)) == brute(set_rows(rows), 20, 5)


def set_rows(rows):
    return [(i, None if v is None else list(v)) for i, v in {(i, None if v is None else tuple(map(str, v))): (i, v)
                                                             for i, v in rows}.values()]


def test_fewer_candidates_and_empty(spark):
    rows = vectors(5, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert answers(nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20)) == brute(rows, 20, 3)
    assert nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_over_many_lists_and_parts(spark):
    rows = vectors(4000, 16, spread=0.8)
    settings = IndexSettings(list_size=100, part_rows=64, part_queries=8, tuning_queries=60)
    got = answers(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10, settings=settings))
    want = brute(rows, 10, 16)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = dict(rows)
    assert all(-s == inner(exact[q], exact[i]) for q, v in got.items() for s, i in v)


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(2)
    centres, x = rng.normal(size=(300, 8)), rng.normal(size=(200, 8))
    at, far = CentroidGraph(centres, 12).search(x, 5)
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(-1))
    true = np.argsort(d, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(at, true, strict=True)]) > 0.95
    np.testing.assert_allclose(far, np.take_along_axis(d, at, axis=1), atol=1e-6)
    one, _ = CentroidGraph(centres[:1], 12).search(x, 3)
    assert one.shape == (200, 1)
    everything, _ = CentroidGraph(np.vstack([centres[:20], centres[:20] + 1000]), 3).search(x[:10], 40)
    assert all(sorted(row) == list(range(40)) for row in everything.tolist())


def test_balanced_centroids_are_evener():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (3000, 4)), rng.normal(6, 0.2, (300, 4))])
    centres = balanced_centroids(x, 16, 0)
    counts = np.bincount(np.argmin(((x[:, None] - centres[None]) ** 2).sum(-1), axis=1), minlength=16)
    assert counts.max() < 3.5 * counts.mean()


def test_query_recall(spark):
    from cohortcart.llm.queries import op8_nearest, table

    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    x = np.array([v for _, v in rows], dtype=np.float64)
    at = {i: p for p, (i, _) in enumerate(rows)}
    got = answers(op8_nearest(spark, sf))
    assert sorted(got) == sorted(i for i in at if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        floor = np.sort(s)[-20] - 1e-12
        hits += sum(s[at[i]] >= floor for _, i in found)
        assert all(abs(-v - s[at[i]]) < 1e-12 for v, i in found)
    assert hits >= 0.9 * 20 * len(got)
