"""Quality rules: countable text rules, then a hashed n-gram log-likelihood ratio.

Every document's word unigrams and bigrams are hashed into a fixed number of buckets.  Two
multinomials over the buckets are counted over the whole input: one of the trusted documents
(the target) and one of all documents (the raw corpus).  A document's score is the mean over
its n-grams of ``ln p_target / p_raw``; it is kept when no base rule fails and the score
reaches a fixed threshold.  No randomness, no sampling: equal texts get equal verdicts.

Spark built-ins only.  The bucket table has a fixed size (``2 * buckets`` numbers) whatever
the corpus, so it travels inside the plan as one array.  Repeated 3-word windows are found
inside the row (sorted windows, O(n log n)), never by exploding windows through a shuffle.

Defined cases: null text counts as no words (base rule fails); a document whose label is null,
missing or not 1 is only raw corpus; with no trusted document at all every ratio is 1, every score
0, and only the base rules decide; an empty table gives an empty result;
repeated rows each count; columns other than ``doc_id`` and ``text`` are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.llm.text import let, words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class RuleSettings:
    """Thresholds.  ``buckets`` must be a power of two."""

    buckets: int = 1 << 15
    smoothing: float = 8.0
    threshold: float = -0.1
    min_words: int = 50
    max_repeat_percent: int = 50


# -- base rules ---------------------------------------------------------------------------------

def repeat_words(w: Column) -> Column:
    """How many words of the array lie in a 3-word window that the text holds at least twice.

    Texts whose window hashes all differ have none.  For the others, windows are sorted by (hash,
    words, position): equal ones become neighbours and the words themselves decide, so a hash
    collision cannot merge two different windows.  Each repeated window then adds the words from
    its start up to the next repeated start, at most three."""
    def hashes(w_: Column) -> Column:
        return F.transform(F.slice(w_, 1, F.greatest(F.size(w_) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(w_, i + 1), F.get(w_, i + 2)))

    def windows(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(
            x.alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
            i.alias("p"))))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def starts_of_repeats(s: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            before = F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False)
            return before | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["p"]))

    def covered(d: Column) -> Column:
        gaps = F.transform(d, lambda p, i: F.least(F.coalesce(F.get(d, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    return let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .otherwise(let(let(windows(h), starts_of_repeats), covered)))


def base_columns(text: Column, w: Column, settings: RuleSettings) -> Column:
    """Struct of the counted properties of one text, and whether a base rule fails."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"))
    return let(counted, lambda c: F.struct(
        *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((c["n_words"] < settings.min_words)
         | (100 * c["n_repeat_words"] > settings.max_repeat_percent * c["n_words"])).alias("base_failed")))


# -- hashed n-grams -----------------------------------------------------------------------------

def ngram_buckets(w: Column, buckets: int, shift: int = 0, kind: str = "int") -> Column:
    """Bucket numbers of all unigrams (``0..buckets-1``) and bigrams (``buckets..2*buckets-1``), less
    ``shift``."""
    mask = F.lit(buckets - 1).cast("long")

    def both(h: Column) -> Column:
        low = (lambda x: x.bitwiseAND(mask) - shift) if shift else (lambda x: x.bitwiseAND(mask))
        high = (lambda x: x.bitwiseAND(mask) + (buckets - shift)) if shift != buckets else (lambda x: x.bitwiseAND(mask))
        one = F.transform(h, lambda x: low(x).cast(kind))
        two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: high(
            F.xxhash64(F.get(h, i), x)).cast(kind))
        return F.concat(one, two)

    return let(F.transform(w, lambda x: F.xxhash64(x)), both)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids marked good quality and not toxic (several labels for an id: all must agree)."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min(good.cast("int")).alias("_good")).where("_good = 1").select("doc_id"))


def bucket_counts(docs: DataFrame, trusted: DataFrame, settings: RuleSettings) -> DataFrame:
    """``(bucket, raw, target)`` counted over all documents; at most ``2 * buckets`` rows.

    All trusted ids count, however many.  Each text is reduced to its bucket numbers in its row (2
    bytes each where they fit), and those are joined with the ids by sorting, at every size; no text
    is shuffled.  Counting is partial per task, and what it shuffles is bounded by tasks x buckets."""
    small = settings.buckets <= 1 << 15
    shift, kind = (settings.buckets, "short") if small else (0, "int")
    grams = docs.select("doc_id", ngram_buckets(words(F.col("text")), settings.buckets, shift, kind).alias("_grams"))
    marked = grams.join(trusted.select("doc_id", F.lit(1).alias("_target")).hint("merge"), "doc_id", "left")
    rows = marked.select(F.coalesce(F.col("_target"), F.lit(0)).cast("long").alias("_target"),
                         F.explode("_grams").alias("_gram"))
    return rows.groupBy((F.col("_gram").cast("int") + shift).alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))


def bucket_ratios(counts: DataFrame, settings: RuleSettings) -> list[float]:
    """``ln p_target / p_raw`` per bucket, rounded to 4 places; unigrams first, then bigrams.

    Each half is a multinomial of its own.  ``smoothing`` is added to the target's counts and, at the
    raw corpus's scale, to its counts: a bucket that neither has seen often gets a ratio near 1, so
    words that only one unlabelled document uses are no evidence against it.  The table is
    collected: its size is ``2 * buckets`` numbers, fixed by the settings."""
    n = settings.buckets
    raw, target = [0] * (2 * n), [0] * (2 * n)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    out = []
    for half in (0, n):
        n_raw, n_target = sum(raw[half:half + n]), sum(target[half:half + n])
        if not n_target:
            out += [0.0] * n
            continue
        share, a = n_target / n_raw, settings.smoothing
        out += [round(math.log((target[i] + a) / (share * raw[i] + a)), 4) for i in range(half, half + n)]
    return out


def ratio_score(w: Column, ratios: list[float], settings: RuleSettings) -> Column:
    """Mean log ratio over the n-grams of the word array; 0 where there are none."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")
    total = let(ngram_buckets(w, settings.buckets), lambda g: F.aggregate(
        g, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / F.greatest(F.size(g), F.lit(1)))
    return total


# -- operator -----------------------------------------------------------------------------------

def verdicts(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> Column:
    """Fits the ratios to ``docs`` and returns the judgement of a row's ``text`` as a struct: the base
    counts, ``base_failed``, ``score`` and ``kept``."""
    ratios = bucket_ratios(bucket_counts(docs, trusted_ids(labels), settings), settings)

    def verdict(w: Column) -> Column:
        return let(F.struct(base_columns(F.col("text"), w, settings).alias("b"),
                            ratio_score(w, ratios, settings).alias("score")),
                   lambda x: F.struct(
                       *[x["b"][k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words", "base_failed")],
                       x["score"].alias("score"),
                       (~x["b"]["base_failed"] & (x["score"] >= settings.threshold)).alias("kept")))

    return let(words(F.col("text")), verdict)


def quality_rules(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """One row per document: its id, the base counts, the score and the verdict."""
    docs = docs.select("doc_id", "text")
    return docs.select("doc_id", verdicts(docs, labels, settings).alias("rules")).select("doc_id", "rules.*")


def keep_good(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(verdicts(docs, labels, settings)["kept"])
