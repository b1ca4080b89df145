"""Vector code compression: product codes of quantised vectors, learnt and assigned in exact integers.

A component ``x`` becomes the integer ``floor(scale * x)``; vectors are cut into equal consecutive
parts, and each part position has a codebook.  It starts as that part of the vectors with the
smallest ids; in each round all parts go to their nearest entry (squared distance, ties to the lower
index), then entries move to the floor of their parts' mean; unused entries stay.

Limb-split exact GEMM.  Distances need the products of all parts with all entries.  Float64 matrix
products are fast but exact only below 2**53, so integers are broken into limbs (the lowest ones
unsigned, the highest signed) narrow enough that a sum over the part's components stays below it.  One
BLAS product per pair of limbs is exact; the pairs are shifted together in int64, and the first
smallest distance wins.  Small integers need one limb, so one product.  The result does not depend on
batches, BLAS threads or the machine.

Spark scans the table once for the first entries, once a round, and once for the codes.  A round's
tasks each pass on one row per used entry (sums and count), which Spark adds up by entry; only the
codebooks (parts x entries, however large the table) reach the driver and are sent out again.  Sums by
label are combined map-side and joined back, so a label on a third of all rows is no hot spot.

Defined cases: a vector that is null or holds null or non-finite components takes no part.  The
dimension is that of most vectors (the larger one of a tie); vectors of another length, empty ones
too, take no part.  A dimension that the parts do not divide is filled up with zeros.  Null ids come
last in the order of ids, and equal ids are ordered by their vectors; rows that repeat are separate
rows; fewer vectors than entries give smaller codebooks; null labels are one label; a table without
vectors gives no rows; very long texts in other columns are never read; other columns are ignored.
Integers too large for squared distances in 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortcart.session import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
EXACT_BITS = 53
BLOCK = 8192               # vectors that a task multiplies at a time


# -- exact products -----------------------------------------------------------------------------

def _magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def limb_bits(terms: int) -> int:
    """Width of a limb such that sums of ``terms`` products of two limbs stay below 2**53."""
    return (EXACT_BITS - 1 - max(terms - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs of int64 ``x``, lowest first: ``x == sum(limb << (bits * i))``."""
    out = []
    while _magnitude(x) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices in int64, by float64 products of limbs."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x``: the first nearest row of ``book``, and the squared distance."""
    if x.shape[1] * (_magnitude(x) + _magnitude(book)) ** 2 >= 1 << 63:
        raise OverflowError("components too large for squared distances in 64 bits")
    ahead = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    best = ahead.argmin(axis=1)
    return best, ahead[np.arange(len(x)), best] + (x * x).sum(axis=1)


# -- codebooks ----------------------------------------------------------------------------------

def quantised(vectors: DataFrame, vector_id: str, vector: str, label: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """``id, label, v`` (integers) of the vectors that take part, and their filled-up length."""
    rows = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(label).alias("label"),
                          F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    zeros = F.array_repeat(F.lit(0).cast("long"), -d % parts)
    return rows.where(F.size("v") == d).select(
        "id", "label", F.concat(F.transform("v", lambda x: F.floor(x * scale).cast("long")), zeros).alias("v")), d + -d % parts


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), d)


def first_entries(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The starting codebooks ``[part, entry, place]`` from the vectors with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    book = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, d // parts)
    return np.ascontiguousarray(book.transpose(1, 0, 2))


def moved_entries(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the entries after all parts went to their nearest ones."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            for low in range(0, len(x), BLOCK):
                for p in range(parts):
                    own = x[low:low + BLOCK, p * width:(p + 1) * width]
                    code, _ = nearest_entries(own, books[p])
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    total[p, used] += np.add.reduceat(own[order], starts, axis=0)
                    count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
             pa.array(list(total[p, e]), type=pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = rows.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    added = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy()
    for r in added.collect():                      # at most parts x entries rows
        out[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
    return out


def fit_codebooks(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``[part, entry, place]`` after ``rounds`` rounds over all ``rows`` of ``quantised``."""
    books = first_entries(rows, d, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = moved_entries(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error``: the entries' indexes in hex and the summed squared distances."""
    parts, _, width = books.shape
    digits = max(2, len(f"{max(books.shape[1] - 1, 0):x}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), parts * width)
            code = np.zeros((len(x), parts), dtype=np.int64)
            error = np.zeros(len(x), dtype=np.int64)
            for low in range(0, len(x), BLOCK):
                for p in range(parts):
                    best, far = nearest_entries(x[low:low + BLOCK, p * width:(p + 1) * width], books[p])
                    code[low:low + BLOCK, p] = best
                    error[low:low + BLOCK] += far
            text = ["".join([f"{c:0{digits}x}" for c in row]) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, type=pa.string()), pa.array(error)],
                                             names=["id", "label", "code", "error"])

    schema = StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(encode, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors (integers) that the codes stand for."""
    parts = len(books)
    digits = len(codes[0]) // parts if codes else 2
    index = np.array([[int(c[p * digits:(p + 1) * digits], 16) for p in range(parts)] for c in codes], dtype=np.int64)
    return np.concatenate([books[p][index.reshape(-1, parts)[:, p]] for p in range(parts)], axis=1)


def vector_codes(vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of the vectors that take part."""
    rows, d = quantised(vectors, vector_id, vector, label, scale, parts)
    books = fit_codebooks(rows, d, parts, entries, rounds)
    codes = stored(encoded(rows, books), "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(vector_id), "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB twin of the query: codes, errors and the digest of the codebooks of ``embeddings``."""
    steps = [f"""
kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
         FROM embeddings WHERE embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS r FROM kept),
parts AS (SELECT r, vec_id, label, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS x
          FROM ranked, (SELECT unnest(range({PARTS})) AS p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (SELECT r, vec_id, label, p, x, e, far FROM (
    SELECT r, vec_id, label, parts.p, x, e, far, row_number() OVER (PARTITION BY r, parts.p ORDER BY far, e) AS place
    FROM (SELECT r, vec_id, label, parts.p, x, e,
                 CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far
          FROM parts JOIN book{k} ON parts.p = book{k}.p) AS parts) WHERE place = 1)""")
        if k < rounds:
            steps.append(f"""
means{k} AS (SELECT p, e, list(mean ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(x[i + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS mean
    FROM near{k}, (SELECT unnest(range((SELECT max(len(x)) FROM parts))) AS i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return "WITH" + ",".join(steps) + f""",
codes AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
          FROM near{rounds} GROUP BY r, vec_id, label),
labels_ AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM codes GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM codes JOIN labels_ ON codes.label IS NOT DISTINCT FROM labels_.label, books"""
