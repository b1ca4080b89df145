import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from cohortcart.llm.vector_codes import (decoded, exact_products, fit_codebooks, limb_bits, limbs, nearest_entries, quantised,
                                         vector_codes)
from tests.llm import odd

SCHEMA = (StructType().add("vec_id", LongType()).add("embedding", ArrayType(DoubleType())).add("label", IntegerType()))
INF, NAN = float("inf"), float("nan")


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract with Python's unbounded integers, one part at a time."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = defaultdict(int)
    for _, v, _ in kept:
        lengths[len(v)] += 1
    d = max(lengths, key=lambda k: (lengths[k], k), default=0)
    kept = [(i, v + [0] * (-d % parts), label) for i, v, label in kept if len(v) == d]
    width = -(-d // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = defaultdict(list)
            for c in cut:
                own[nearest(c[p], book)[1]].append(c[p])
            new.append([[sum(col) // len(own[k]) for col in zip(*own[k], strict=True)] if k in own else e
                        for k, e in enumerate(book)])
        books = new
    out, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in near), sum(f for f, _ in near), label])
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(odd.key((i, code, error, by_label[label], sha)) for i, code, error, label in out)


def got(df):
    return sorted(odd.key((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in df.collect())


def awkward():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, 3, None])) for i in range(80)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None] * 4, 1), (203, [NAN] + [0.0] * 7, 1), (204, [INF] * 8, 1),
             (205, [-INF] + [1.0] * 7, 1), (206, [0.5] * 7, 1), (207, [0.0] * 8, 9), (208, [-0.0] * 8, 9),
             (209, [1e-9, -1e-9, 0.25, -0.25, 1.0, -1.0, 1000.5, -1000.5], 9), (None, [0.125] * 8, 2), (None, None, None)]
    return rows + [rows[5]] * 4 + [(rows[6][0], rows[7][1], 5)] + [(300 + i, [1.0] * 8, 7) for i in range(40)]


@pytest.mark.parametrize("entries", [16, 256])
def test_rows_equal_brute_force_with_odd_cases(spark, entries):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    for name in ("id", "v", "error", "_label", "part", "entry", "sums", "n", "codebooks_sha256"):
        df = df.selectExpr("*", f"concat('x', vec_id) AS `{name}`")
    assert got(vector_codes(df, entries=entries)) == brute(awkward(), entries=entries)


def test_large_integers_dimension_not_divided_and_other_columns(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.randint(0, 17) for _ in range(7)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).toDF("key", "vec", "kind").selectExpr("*", "repeat('y', 100000) AS text")
    out = vector_codes(df, "key", "vec", "kind", entries=8).withColumnRenamed("key", "vec_id")
    assert got(out) == brute(rows, entries=8)


def test_text_labels_and_one_hot_label(spark):
    schema = StructType().add("vec_id", LongType()).add("embedding", ArrayType(DoubleType())).add("label", StringType())
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)], "hot" if i % 3 else None) for i in range(90)]
    assert got(vector_codes(spark.createDataFrame(rows, schema), entries=4)) == brute(rows, entries=4)


def test_empty_tables(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes(spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [NAN], None)], SCHEMA)).count() == 0


def test_exact_products_beyond_float64():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-2 ** 29, 2 ** 29, size=(20, 16)) for _ in range(2))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])
    assert (exact_products(a, b) == want).all()
    assert not ((a.astype(float) @ b.astype(float).T).astype(np.int64) == want).all()
    for terms in (1, 2, 16, 17, 4096):
        assert terms * (2 ** limb_bits(terms) - 1) ** 2 < 2 ** 53
    for x in (np.array([[-2 ** 31, 2 ** 31 - 1, 0, -1]]), np.zeros((0, 4), dtype=np.int64)):
        assert (sum(part.astype(np.int64) << (9 * i) for i, part in enumerate(limbs(x, 9))) == x).all()


def test_first_smallest_distance_wins_and_overflow_raises():
    book = np.array([[5, 5], [1, 1], [1, 1]])
    assert [a.tolist() for a in nearest_entries(np.array([[0, 0], [3, 3]]), book)] == [[1, 0], [2, 8]]
    with pytest.raises(OverflowError):
        nearest_entries(np.array([[2 ** 33, 0]]), book)


def test_codes_decode_to_entries(spark):
    rows = [(i, [float(i % 5)] * 8, 0) for i in range(50)]
    table, d = quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 1024, 4)
    books = fit_codebooks(table, d, entries=5)
    codes = vector_codes(spark.createDataFrame(rows, SCHEMA), entries=5).orderBy("vec_id").collect()
    assert (decoded([r["code"] for r in codes], books) == [[1024 * (i % 5)] * 8 for i in range(50)]).all()
    assert {r["error"] for r in codes} == {0}


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op11_vector_codes, table

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, sf, "embeddings").collect()]
    assert got(op11_vector_codes(spark, sf)) == brute(rows)
