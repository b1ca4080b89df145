"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of copies the mix should hold of it on average.  Among all
rates between 0 and ``cap`` that give each source its target of words, the rates closest in
relative entropy to one copy of everything are ``min(cap, exp(lambda_source * size / mean))``.  The
dual of that problem is convex with one variable per source; Newton's method, kept inside a
bracket, solves it.  Every iteration is one aggregation over the stored (source, size) counts, and
the state of all sources (tilt, bracket, target) is a stored table as well: any number of sources is
solved alike, and only a few numbers reach the driver.

Rates become whole copies: the floor always, and one more for documents whose seeded hash falls
below a cut.  The cuts are set per source and size class, largest documents first, each class
also making up what the classes before it missed, so the words taken miss the target by about one
of the source's smallest documents.  Rows that are equal in every column share a hash, so they are
counted first: of ``m`` such rows as many get one copy more as their rate times ``m`` says, and
which of them is all the same.  Nothing depends on partitions or row order: reruns agree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target
stops at ``cap`` times its source's words and the excess is shared again by weight.

Defined cases: null text has size 0; documents of size 0 are never taken; null is a source of its
own; a source without words has target 0; very long texts count by their words like any other;
rows equal in id and text but not in other columns are rounded on their own; an empty table gives
no rows; rows travel as one struct, so no column name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from cohortcart.llm.text import words
from cohortcart.operators.ranking import global_row_number
from cohortcart.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 1024
NEWTON_STEPS = 80
CLOSE = 1e-7               # relative miss at which a source is solved


@dataclass(frozen=True)
class Mixture:
    """A fitted mix: ``sources`` (key, source_size, target, rate_scale, full), ``cuts`` (source,
    size_class, cut) and ``repeated`` (a, b, m: the rows that come ``m`` times)."""

    sources: DataFrame
    cuts: DataFrame
    repeated: DataFrame
    cap: int
    seed: int


def with_targets(totals: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``totals`` (source, words, docs: one row a source) with ``target``.

    At level ``s`` a source wants ``weight * s`` words or, if that is more, ``cap`` times its own.  The
    level rises until all words are shared; each rise is one sum over the sources."""
    order = [("_none", True), ("source", True)]
    ranked = global_row_number(totals.withColumn("_none", F.col("source").isNull()), order, "_place")
    place = (F.col("_place") - 1) % len(weights)
    weight = reduce(lambda rest, i: F.when(place == i, F.lit(float(weights[i]))).otherwise(rest),
                    range(len(weights)), F.lit(0.0))
    ranked = stored(ranked.withColumn("_weight", weight).withColumn("_most", F.col("words").cast("double") * cap),
                    "source-weights")
    level, before = 0.0, None
    while level != before:
        before = level
        stops = F.col("_most") < F.col("_weight") * F.lit(level)
        row = ranked.agg(F.sum(F.col("words").cast("double")).alias("all"), F.sum(F.when(stops, F.col("_most")).otherwise(0.0)).alias("held"),
                         F.sum(F.when(stops, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        if row["open"]:
            level = max(level, (row["all"] - row["held"]) / row["open"])
    return ranked.select("source", "words", "docs", F.least(F.col("_weight") * F.lit(level), F.col("_most")).alias("target"))


def _digest(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row; rows with both equal are taken for equal."""
    texts = [F.coalesce(F.to_json(F.struct(f.name)), F.lit("")) if isinstance(f.dataType, (ArrayType, MapType, StructType))
             else F.col(f.name) for f in docs.schema.fields]
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in docs.columns])
    return [F.xxhash64(F.lit(k), nulls, *texts).alias(name) for k, name in ((3, "_mix_a"), (4, "_mix_b"))]


def _basics(docs: DataFrame, seed: int) -> list[Column]:
    """Of a document: its source, its size, the size's binary logarithm, a hash from 0 to 1, and the
    row's digest."""
    size = F.size(words(F.col("text"))).cast("long")
    a, b = _digest(docs)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a, b), 11) / F.lit(float(1 << 53))
    return [F.col("source").cast("string").alias("_mix_source"), size.alias("_mix_size"),
            F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int").alias("_mix_class"), u.alias("_mix_u"), a, b]


def _rate(cap: int) -> Column:
    tilted = F.least(F.exp(F.least(F.col("rate_scale") * F.col("_mix_size"), F.lit(50.0))), F.lit(float(cap)))
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(tilted)


def _bin(rate: Column) -> Column:
    """Where the hash stands against the rate's fraction: bins below the cut get one copy more."""
    return F.floor((F.col("_mix_u") - (rate - F.floor(rate)) + 1) * (BINS // 2)).cast("int")


def _extra(rate: Column, m: Column) -> Column:
    """How many of ``m`` equal rows get one copy more."""
    return F.floor(m * (rate - F.floor(rate)) + F.col("_mix_u")).cast("long")


def _solve(counts: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """Newton on the dual: ``sources`` (key, words, docs, target) with ``rate_scale`` and ``full`` (the cap
    binds everywhere).  Each step joins the state of all sources to the counts, adds up and stores."""
    mean = F.greatest(F.col("words") / F.col("docs"), F.lit(1.0))
    none = F.lit(None).cast("double")
    full = F.col("target") >= cap * F.col("words") * (1 - 1e-12)
    state = stored(sources.select("key", "words", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), none.alias("low"),
                                  none.alias("high"), full.alias("full"), (full | (F.col("target") <= 0)).alias("done")), "tilts")
    for _ in range(NEWTON_STEPS):
        if state.where("not done").isEmpty():
            break
        now = state.where("not done").select("key", (F.col("tilt") / F.col("mean")).alias("rate_scale"), "full")
        words_at = F.col("n") * F.col("_mix_size") * F.col("_rate")
        at = (counts.join(now, counts["source"].eqNullSafe(now["key"])).withColumn("_rate", _rate(cap)).groupBy("key")
              .agg(F.sum(words_at).alias("taken"), F.sum(F.when(F.col("_rate") < cap, words_at * F.col("_mix_size")).otherwise(0.0)).alias("slope")))
        at = at.withColumnRenamed("key", "k")
        miss = F.col("taken") - F.col("target")
        close = F.abs(miss) <= CLOSE * F.col("target")
        low = F.when(miss > 0, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = (state.join(at, state["key"].eqNullSafe(at["k"]), "left").withColumn("_open", ~F.col("done") & ~F.coalesce(close, F.lit(False)))
                 .withColumn("_low", low).withColumn("_high", high)
                 .withColumn("_step", F.when(F.col("slope") > 0, F.col("tilt") - miss * F.col("mean") / F.nullif("slope", F.lit(0.0)))))
        inside = (F.coalesce(F.col("_step") > F.col("_low"), F.lit(True)) & F.coalesce(F.col("_step") < F.col("_high"), F.lit(True))
                  & (F.abs(F.col("_step") - F.col("tilt")) <= 8))
        step = (F.when(F.coalesce(inside, F.lit(False)), F.col("_step"))
                .when(F.col("_low").isNull(), F.least(2 * F.col("_high"), F.col("_high") - 1))
                .when(F.col("_high").isNull(), F.greatest(2 * F.col("_low"), F.col("_low") + 1))
                .otherwise((F.col("_low") + F.col("_high")) / 2))
        is_open = F.col("_open")
        state = stored(moved.select(
            "key", "words", "target", "mean", F.when(is_open, step).otherwise(F.col("tilt")).alias("tilt"),
            F.when(is_open, F.col("_low")).otherwise(F.col("low")).alias("low"),
            F.when(is_open, F.col("_high")).otherwise(F.col("high")).alias("high"), "full", (~is_open).alias("done")), "tilts")
    scale = F.bround(F.col("tilt") / F.col("mean"), 15)        # the same in every run, whatever the order of sums
    return state.select("key", F.col("words").alias("source_size"), "target", scale.alias("rate_scale"), "full")


def _cuts(bins: pd.DataFrame) -> pd.DataFrame:
    """One source's cuts, from its words per size class and bin; classes from large to small."""
    carry, out = 0.0, []
    for size_class, rows in sorted(bins.groupby("_mix_class"), key=lambda x: -x[0]):
        want = rows["wanted"].sum() + carry
        rows = rows[rows["bin"] >= 0].sort_values("bin")
        reached = rows["words"].cumsum().to_numpy()
        best = min(range(len(rows) + 1), key=lambda k: abs((reached[k - 1] if k else 0) - want))
        carry = want - (reached[best - 1] if best else 0)
        cut = int(rows["bin"].iloc[best]) if best < len(rows) else 2 * BINS
        out.append((bins["source"].iloc[0], int(size_class), cut))
    return pd.DataFrame(out, columns=["source", "size_class", "cut"])


def fit_mixture(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 5) -> Mixture:
    """Targets, rates and cuts for ``docs`` (columns ``doc_id, text, source`` and any others)."""
    rows = docs.select(*_basics(docs, seed))
    keys = ["_mix_a", "_mix_b", "_mix_source", "_mix_size", "_mix_class", "_mix_u"]
    slim = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), "sizes").withColumnRenamed("_mix_source", "source")
    counts = stored(slim.groupBy("source", "_mix_size").agg(F.sum("m").alias("n")), "size-counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("_mix_size")).alias("words"), F.sum("n").alias("docs"))
    sources = stored(_solve(counts, with_targets(totals, weights, cap).withColumnRenamed("source", "key"), cap), "sources")
    repeated = stored(slim.where("m > 1").select("_mix_a", "_mix_b", "m"), "repeated")
    named = sources.select("key", "rate_scale", "full")
    part = F.col("_rate") - F.floor("_rate")
    several = F.col("m") > 1
    # rows that repeat are rounded as a group; what that misses is wanted of the others of their class
    missed = (F.col("m") * part - _extra(F.col("_rate"), F.col("m"))) * F.col("_mix_size")
    bins = (slim.where("_mix_size > 0").join(named, F.col("source").eqNullSafe(F.col("key")))
            .withColumn("_rate", _rate(cap)).where(part > 0)
            .groupBy("source", "_mix_class", F.when(several, F.lit(-1)).otherwise(_bin(F.col("_rate"))).alias("bin"))
            .agg(F.sum(F.when(several, 0).otherwise(F.col("_mix_size"))).alias("words"),
                 F.sum(F.when(several, missed).otherwise(part * F.col("_mix_size"))).alias("wanted")))
    cuts = bins.groupBy("source").applyInPandas(_cuts, "source string, size_class int, cut int")
    return Mixture(sources, stored(cuts, "cuts"), repeated, cap, seed)


def with_copies(docs: DataFrame, mix: Mixture) -> DataFrame:
    """``doc`` (struct of all columns of ``docs``), ``size``, ``source_size``, ``target``, ``copies``: one
    row for each row of ``docs``."""
    whole = F.struct(*docs.columns).alias("doc")
    basics = ["_mix_source", "_mix_size", "_mix_class", "_mix_u", "_mix_a", "_mix_b"]
    made = docs.select(whole, *_basics(docs, mix.seed)).withColumn("_mix_m", F.lit(1).cast("long"))
    again = mix.repeated.withColumnsRenamed({"_mix_a": "_again_a", "_mix_b": "_again_b"})
    if not again.isEmpty():
        # equal rows become one with a count
        same = (F.col("_mix_a") == F.col("_again_a")) & (F.col("_mix_b") == F.col("_again_b"))
        one = (made.join(again, same, "left_semi").groupBy(*basics)
               .agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("_mix_m")))
        made = made.join(again, same, "left_anti").select("doc", *basics, "_mix_m").unionByName(
            one.select("doc", *basics, "_mix_m"))
    cuts = mix.cuts.select(F.col("source").alias("_mix_c"), "size_class", "cut")
    made = made.join(mix.sources, F.col("_mix_source").eqNullSafe(F.col("key")), "left")
    made = made.join(cuts, F.col("_mix_source").eqNullSafe(F.col("_mix_c")) & (F.col("_mix_class") == F.col("size_class")), "left")
    made = made.withColumn("_rate", _rate(mix.cap))
    rate, m = F.col("_rate"), F.col("_mix_m")
    more = F.when(m > 1, _extra(rate, m)).otherwise(
        (F.coalesce(_bin(rate) < F.col("cut"), F.lit(False)) & (rate > F.floor(rate))).cast("long"))
    made = made.withColumn("_more", more)
    each = made.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), m)))
    copies = F.when(F.col("_mix_size") == 0, F.lit(0)).otherwise(F.floor(rate) + (F.col("_k") <= F.col("_more")).cast("int")).cast("long")
    return each.select("doc", F.col("_mix_size").alias("size"), "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, mix: Mixture) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    return (with_copies(docs, mix).where("copies > 0")
            .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*"))
