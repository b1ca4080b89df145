"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text is reduced to a few statistics (word lengths, signs, capitals, repeats ...), computed by
Spark's own functions.  Random Fourier features of the standardised statistics approximate a
Gaussian kernel; the ridge normal equations are summed per partition and fold, so a fold's model
is solved from sums alone and the penalty is the one with the least error on left-out folds.
Scores that left-out folds get are binned, and isotonic regression turns them into the
probability of label 1.

Only the statistics of labelled documents are gathered, each document once and about ``max_labelled``
of them at most: ids first, then rows, each by a share of its hashes' range, so an id on a third of all
rows is bounded and spread like any other.  All documents are scored.  Statistics never include
labels, language, source or id.

Defined cases: a null or empty text has all statistics 0 and gets the score such texts get;
several labels for an id are averaged and rounded up from a half; a null label is none; with no
labels, or one kind only, every score is that kind's share (0.5 without labels); very long texts are
counted whole; repeated rows score alike and are one example; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.llm.text import let, words
from cohortcart.session import stored

FOLDS = 4
HELD_OUT_FOLD = 2
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
CALIBRATION_BINS = 2000
SUM_PARTITIONS = 16
ROWS_PER_BLOCK = 32
CHUNK = 2048                 # rows whose features are held at once


@dataclass(frozen=True)
class ClassifierSettings:
    features: int = 192
    bandwidth: float = 3.0
    max_labelled: int = 200_000
    keep_at: float = 0.7
    seed: int = 11


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == HELD_OUT_FOLD


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


STATISTICS = ("log_words", "mean_word", "distinct_words", "signs", "capitals", "calls", "digits",
              "points", "repeats", "line_breaks", "repeated_lines", "wide_chars", "odd_chars")


def statistics(text: Column) -> Column:
    """Struct of doubles: what the score is computed from."""
    t = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(t), F.lit(1)).cast("double")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
        repeats = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: x == y), lambda same: same))
        values = (
            F.log1p(F.size(w).cast("double")),
            F.log1p(F.length(t) / n),
            F.size(F.array_distinct(w)) / n,
            F.least(count(r"[#*$%&|<>=~^_\\{}]") / n, F.lit(4.0)),
            count(r"[A-Z]") / chars,
            F.least(count(r"[!?]") / n, F.lit(4.0)),
            count(r"[0-9]") / chars,
            F.least(count(r"[.,;:]") / n, F.lit(4.0)),
            repeats / n,
            F.least(count(r"\n") / n, F.lit(2.0)),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1))),
            (F.octet_length(t) - F.length(t)) / chars,
            F.least(count(r"[@/\[\]()]") / n, F.lit(4.0)),
        )
        return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k)
                          for k, v in zip(STATISTICS, values, strict=True)])

    return let(words(t), of_words)


@dataclass(frozen=True)
class Model:
    """Everything a task needs to score: a few small arrays."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray          # one column per left-out fold, the last of all folds
    steps_at: np.ndarray
    steps: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, column: np.ndarray | int = -1) -> np.ndarray:
        scores = self.lifted(x) @ self.weights
        return scores[np.arange(len(x)), column]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.concatenate([self.raw(x[at:at + CHUNK]) for at in range(0, max(len(x), 1), CHUNK)])
        return np.clip(np.interp(raw, self.steps_at, self.steps), 0, 1)


def _some(rows: DataFrame, n: int, most: int, key: Column) -> DataFrame:
    """About ``most`` of the ``n`` rows, those whose key's hash falls below a share of its range."""
    return rows if n <= most else rows.where(F.shiftrightunsigned(key, 11) < F.lit(int(most / n * (1 << 53))))


def labelled_statistics(docs: DataFrame, labels: DataFrame, settings: ClassifierSettings) -> DataFrame:
    """``fold, deal, y`` and the statistics of the labelled documents that are not held out, copies of a
    document once; at most about ``max_labelled`` ids and as many rows.  ``deal`` (a hash of the row)
    spreads them over the tasks that add up, so an id on many texts is spread as well."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    known = stored(known, "label-ids")
    known = _some(known, known.count(), settings.max_labelled, F.xxhash64(F.lit(settings.seed), "doc_id"))
    # about max_labelled rows of two numbers, whatever the input, so texts need not be shuffled to meet them
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = found.select("doc_id", "y", statistics(F.col("text")).alias("s")).select("doc_id", "y", "s.*").distinct()
    rows = stored(rows.withColumn("deal", F.xxhash64(F.lit(settings.seed + 1), "doc_id", *STATISTICS)), "labelled-rows")
    rows = _some(rows, rows.count(), settings.max_labelled, F.col("deal"))
    return rows.select(fold(F.col("doc_id")).alias("fold"), "deal", "y", *STATISTICS)


def _normal_sums(sample: DataFrame, lift, width: int) -> dict[int, np.ndarray]:
    """Per fold the sums of ``[z y]^T [z y]`` (``width + 1`` square), added up per partition first."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in (f.iloc[at:at + CHUNK] for f in frames for at in range(0, len(f), CHUNK)):
            z = np.hstack([lift(frame[list(STATISTICS)].to_numpy()), frame[["y"]].to_numpy()])
            for k, rows in frame.groupby("fold").indices.items():
                sums[k] = sums.get(k, 0) + z[rows].T @ z[rows]
        for k, total in sums.items():
            yield pd.DataFrame([(int(k), b, total[b:b + ROWS_PER_BLOCK].tobytes())
                                for b in range(0, width + 1, ROWS_PER_BLOCK)], columns=["fold", "block", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in sorted(frame["sums"])], axis=0)
        return pd.DataFrame([(frame["fold"].iloc[0], frame["block"].iloc[0], total.tobytes())],
                            columns=["fold", "block", "sums"])

    schema = "fold int, block int, sums binary"
    rows = (sample.repartition(SUM_PARTITIONS, "deal").mapInPandas(partial, schema)
            .groupBy("fold", "block").applyInPandas(added, schema).collect())
    out: dict[int, np.ndarray] = {}
    for r in rows:
        block = np.frombuffer(r["sums"]).reshape(-1, width + 1)
        out.setdefault(r["fold"], np.zeros((width + 1, width + 1)))[r["block"]:r["block"] + len(block)] = block
    return out


def _ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    a, b, n = sums[:-1, :-1], sums[:-1, -1], sums[-2, -2]
    shrink = np.full(len(b), penalty * n)
    shrink[-1] = 1e-9 * n        # the constant is not shrunk
    return np.linalg.solve(a + np.diag(shrink), b)


def _error(sums: np.ndarray, w: np.ndarray) -> float:
    v = np.append(w, -1.0)
    return float(v @ sums @ v)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted ``x``: block centres and their rising rates."""
    blocks: list[list[float]] = []
    for at, count, hits in zip(x, n, positive, strict=True):
        blocks.append([at * count, count, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit_classifier(docs: DataFrame, labels: DataFrame,
                   settings: ClassifierSettings = ClassifierSettings()) -> Model:
    sample = labelled_statistics(docs, labels, settings)
    moments = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                         *[F.avg(k).alias(f"{k}_mean") for k in STATISTICS],
                         *[F.stddev_pop(k).alias(f"{k}_spread") for k in STATISTICS]).first()
    d, width = len(STATISTICS), settings.features + 1
    rng = np.random.default_rng(settings.seed)
    base = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, settings.features)) / settings.bandwidth,
                 rng.uniform(0, 2 * np.pi, settings.features), np.zeros((width, FOLDS + 1)),
                 np.array([0.0]), np.array([0.5]))
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        rate = 0.5 if not moments["n"] else moments["y"]
        return Model(**{**base.__dict__, "steps": np.array([rate])})
    mean = np.array([float(f"{moments[f'{k}_mean']:.9g}") for k in STATISTICS])
    spread = np.array([float(f"{moments[f'{k}_spread']:.9g}") for k in STATISTICS])
    base = Model(**{**base.__dict__, "mean": mean, "spread": np.where(spread > 1e-9, spread, 1.0)})

    sums = _normal_sums(sample, base.lifted, width)
    everything = sum(sums.values())
    left_out = {k: everything - s if len(sums) > 1 else s for k, s in sums.items()}
    penalty = min(PENALTIES, key=lambda p: sum(_error(sums[k], _ridge(left_out[k], p)) for k in sums))
    weights = np.zeros((width, FOLDS + 1))
    weights[:, -1] = _ridge(everything, penalty)
    for k in range(FOLDS):
        weights[:, k] = _ridge(left_out[k], penalty) if k in sums else weights[:, -1]
    fitted = Model(**{**base.__dict__, "weights": weights})

    def out_of_fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[at:at + CHUNK] for f in frames for at in range(0, len(f), CHUNK)):
            raw = fitted.raw(frame[list(STATISTICS)].to_numpy(), frame["fold"].to_numpy())
            yield pd.DataFrame({"bin": np.round(np.clip(raw, -1, 2) * CALIBRATION_BINS).astype(int), "y": frame["y"]})

    bins = (sample.mapInPandas(out_of_fold, "bin long, y double").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).orderBy("bin").collect())
    at, rates = isotonic(np.array([r["bin"] for r in bins]) / CALIBRATION_BINS,
                         np.array([float(r["n"]) for r in bins]), np.array([r["hits"] for r in bins]))
    return Model(**{**fitted.__dict__, "steps_at": at, "steps": rates})


def score_function(model: Model):
    """A function of a struct of ``STATISTICS``; only the statistics are sent to Python, not the texts."""
    @F.pandas_udf("double")
    def scored(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(rows[list(STATISTICS)].to_numpy()))

    return scored


def quality_scores(docs: DataFrame, labels: DataFrame,
                   settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    docs = docs.select("doc_id", "text")
    model = fit_classifier(docs, labels, settings)
    # the statistics are columns of their own, so rows that wait for Python do not hold their texts
    rows = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    return rows.select("doc_id", score_function(model)(F.struct(*STATISTICS)).alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= settings.keep_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame,
              settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """The documents predicted to be good, with all their columns."""
    scored = score_function(fit_classifier(docs, labels, settings))
    return docs.where(scored(statistics(F.col("text"))) >= settings.keep_at)
