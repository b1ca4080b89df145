"""SimHash near-duplicates: covering locality-sensitive hashing over 64-bit fingerprints.

A fingerprint bit is the majority vote of that bit over the XXH64 hashes of a text's word
shingles.  Two fingerprints link when at most ``max_bits`` bits differ.

Candidates come from a covering family of ``2**(max_bits+1) - 1`` bit masks: every bit gets a
non-zero vector of ``max_bits + 1`` bits, and mask ``v`` keeps the bits whose vector has odd
overlap with ``v``.  For any ``max_bits`` differing bits some ``v`` is orthogonal to all their
vectors, so that mask keeps none of them and the pair falls in the same bucket: no linked pair is
missed, whatever the data.  Equal fingerprints are merged before (one row per fingerprint), so
groups of copies cost one row.  A bucket with more than ``CROWDED`` fingerprints is not compared
inside: its rows are dealt again by a covering family over the bits the bucket does not fix, which
keeps the guarantee; after three levels at most a few bits are free and a bucket cannot be large.
Buckets therefore have a bounded size, rows grow in proportion, and each bucket passes on the edges
of its spanning stars only, never all pairs.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; fewer
words than a shingle make one shingle of them all; very long texts are read in segments, whole;
repeated rows get equal results; a null ``doc_id`` takes the component of its fingerprint and is never
a component's name unless all are null; ``keep_one`` keeps one row of each group whatever the ids,
null and repeated ones included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.llm.components import components
from cohortcart.session import stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
CROWDED = 96
SEGMENT_BYTES = 1 << 22
LEVELS = 3


# -- fingerprints -------------------------------------------------------------------------------

def word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data``, in lists from segments of about ``SEGMENT_BYTES`` cut at spaces."""
    at = 0
    while len(data) - at > SEGMENT_BYTES:
        cut = data.find(b" ", at + SEGMENT_BYTES)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def fingerprint(data: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text; ``bytes.lower`` and ``bytes.split`` treat ASCII only, as wanted."""
    hash64 = xxhash.xxh64_intdigest
    counts, n, last = np.zeros(64, dtype=np.int64), 0, []
    for run in word_runs(data.lower()):
        run = last + run
        if len(run) >= shingle:
            grams = zip(*[run[k:] for k in range(shingle)], strict=False)
            hashes = np.array([hash64(b" ".join(g), seed) for g in grams], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
        last = run[len(run) - shingle + 1:] if len(run) >= shingle and shingle > 1 else run if shingle > 1 else []
    if not n:
        if not last:
            return 0
        return hash64(b" ".join(last), seed)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _tag() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, tag, fp``: ``tag`` tells texts apart (MD5), the fingerprint is a signed long."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))],
                                             names=["doc_id", "tag", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"), _tag().alias("tag"))
    return texts.mapInArrow(hashed, "doc_id long, tag string, fp long")


# -- covering masks -----------------------------------------------------------------------------

def covering_masks(max_bits: int, fixed: int = 0) -> list[int]:
    """Masks over the bits outside ``fixed`` (each also keeps ``fixed``) such that any ``max_bits``
    of those bits are all left out by at least one mask."""
    size = 2 ** (max_bits + 1) - 1
    free = [b for b in range(64) if not fixed >> b & 1]
    vector = {b: 1 + rank % size for rank, b in enumerate(free)}
    return [fixed | sum(1 << b for b in free if (vector[b] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask_array(masks: list[int]) -> Column:
    """The masks as an array literal, folded by the optimiser; a fixed number of them."""
    return F.split(F.lit(",".join(str(_signed(m)) for m in masks)), ",").cast("array<long>")


def _dealt(rows: DataFrame, masks: list[int], per_parent: int) -> DataFrame:
    """Each row in all buckets of its level: ``t`` numbers the mask, ``key`` holds the kept bits."""
    own = F.slice(_mask_array(masks), F.col("parent") * per_parent + 1, F.lit(per_parent))
    spread = rows.select("fp", "parent", F.posexplode(own).alias("j", "mask"))
    return spread.select("fp", (F.col("parent") * per_parent + F.col("j")).alias("t"),
                         F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _stars(max_bits: int):
    """Per bucket (a list of fingerprints): an edge from each fingerprint to its star's centre."""
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            a, b = flat[starts[sizes == 2]], flat[starts[sizes == 2] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
            us, vs = [a[near]], [b[near]]
            for s, k in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                x = flat[s:s + k]
                linked = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= max_bits
                root = np.arange(k)
                while True:
                    lower = np.where(linked, root[None, :], k).min(axis=1)
                    if (lower == root).all():
                        break
                    root = lower
                us.append(x[root != np.arange(k)])
                vs.append(x[root[root != np.arange(k)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))],
                                             names=["u", "v"])
    return inside


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(u, v)`` that join all distinct fingerprints (column ``fp``) linked directly or over
    others: the components of the edges are those of all linked pairs."""
    per_parent = 2 ** (max_bits + 1) - 1
    rows, masks, found = distinct.select("fp", F.lit(0).alias("parent")), [0], []
    for level in range(1, LEVELS + 1):
        masks = [m for parent in masks for m in covering_masks(max_bits, parent)]
        dealt = _dealt(rows, masks, per_parent)
        sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(dealt.join(sizes, ["t", "key"]), f"buckets{level}")
        last = level == LEVELS
        ready = shared if last else shared.where(F.col("n") <= CROWDED)
        lists = ready.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(lists.mapInArrow(_stars(max_bits), "u long, v long"))
        crowded = shared.where(F.col("n") > CROWDED)
        if last or crowded.isEmpty():
            break
        rows = crowded.select("fp", F.col("t").alias("parent"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- operator -----------------------------------------------------------------------------------

def _rooted(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tag, fp`` of all rows, and ``fp, least, root`` of the distinct fingerprints: the smallest
    id with it, and the fingerprint that names its component."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, max_bits))
    return marked, distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the fingerprint as 16 hex digits, and the smallest
    ``doc_id`` reachable over links."""
    marked, named = _rooted(docs, shingle, max_bits)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, all columns: of the group's rows the one with the smallest id (null
    last), then the smallest MD5 of its text, then the smallest hash of the whole row."""
    marked, named = _rooted(docs, shingle, max_bits)
    # one (id, text) per group; ids may repeat or be null, so the text is part of the choice
    pairs = marked.groupBy("fp", "doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "tag", "n")
    per_fp = pairs.groupBy("fp").agg(F.min(first).alias("first"))
    chosen = (per_fp.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
              .select("root", F.col("first.id").alias("c_id"), F.col("first.tag").alias("c_tag"), F.col("first.n").alias("n")))
    chosen = stored(chosen, "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), _tag().alias("tag"))

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, (F.col("tag") == F.col("c_tag")) & F.col("id").eqNullSafe(F.col("c_id")))

    once = of(chosen.where("n = 1")).select("doc.*")
    if chosen.where("n > 1").isEmpty():
        return once
    # rows that repeat an id with its text: one of them
    order = F.xxhash64(*[F.col("doc")[c] for c in docs.columns])
    again = of(chosen.where("n > 1")).groupBy("root").agg(F.min_by("doc", order).alias("doc"))
    return once.unionByName(again.select("doc.*"))
