"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text and one end.  The model predicts a *symbol*: one of the most
frequent words, the end, or the class of any other word (a fixed hash of its last bytes).  A
context vector is the sum of the two preceding symbols' vectors, each weighted by its position; a
symbol's score is its product with the context plus a bias.  A word that is not a symbol gets its class's
probability times the word's share of its class, so probabilities of all words and of one unseen
word per class add up to 1.

Training covers every training document: each task runs noise-contrastive minibatches over its part
of the stored symbols, from a common start at the unigram distribution, and the tasks'
parameters are averaged by tokens.  Batched matrix products over all pairs of preceding symbols then
give the normaliser of every context, so token log-probabilities are exactly normalised.

Word counts are grouped by word across the corpus.  The most frequent ``head_words`` counts (a
bounded table) are given to all tasks; every other word's count is found by a join on the word.  What
is shuffled follows the corpus; only the head, per-class sums and parameters reach the driver.

Defined cases: a null text is empty and has the end only; words may be of any length; a null
``doc_id`` is a training document and keeps its null; repeated rows are scored alike and counted as
often as they come; with no training documents all counts are 0 and scores are still finite; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcart.llm.simhash import word_runs
from cohortcart.session import stored

END = b"\n"                    # no word can be a line break
SMOOTHING = 0.1
FLUSH_WORDS = 500_000          # distinct words a task counts before it passes the counts on


@dataclass(frozen=True)
class ModelSettings:
    symbols: int = 768         # frequent words predicted on their own, the end included
    classes: int = 256
    head_words: int = 200_000
    width: int = 16
    batch: int = 512
    noise: int = 32
    rate: float = 0.005
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


# -- counts -------------------------------------------------------------------------------------

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def token_counts(docs: DataFrame, classes: int) -> DataFrame:
    """``word, cls, n`` over the training documents; the end has class -1."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            words = list(found)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, type=pa.binary()),
                 pa.array([-1 if w == END else word_class(w, classes) for w in words], type=pa.int32()),
                 pa.array(list(found.values()), type=pa.int64())], names=["word", "cls", "n"])

        for batch in batches:
            found[END] += batch.num_rows
            for text in batch.column(0):
                for run in word_runs(text.as_py().translate(_LOWER)):
                    found.update(run)
                if len(found) > FLUSH_WORDS:
                    yield passed_on()
                    found = Counter()
        found = +found
        if found:
            yield passed_on()

    rows = _texts(docs).where(~F.col("held_out")).select("text")
    return (rows.mapInArrow(counted, "word binary, cls int, n long").groupBy("word", "cls")
            .agg(F.sum("n").alias("n")))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Vocabulary:
    """Head words with counts and symbols, and per class what the other words hold."""

    head: dict[bytes, int]              # word -> row of the arrays below
    log_count: np.ndarray               # log10(count + smoothing)
    symbol: np.ndarray                  # the word's own symbol or its class's
    symbol_counts: np.ndarray           # training tokens per symbol
    class_space: np.ndarray             # log10 of the smoothed total per class
    tokens: int
    distinct: int
    least_head: int                     # no word outside the head has a larger count
    settings: ModelSettings

    @property
    def size(self) -> int:
        return self.settings.symbols + self.settings.classes


def vocabulary(counts: DataFrame, settings: ModelSettings) -> Vocabulary:
    s = settings
    head = counts.orderBy(F.desc("n"), "word").limit(s.head_words).select("word", "cls", "n").toArrow()
    words, n = head.column("word").to_pylist(), head.column("n").to_numpy()
    cls = head.column("cls").to_numpy()
    sums = {r["cls"]: (r["n"], r["v"]) for r in
            counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    own = [i for i in range(len(words)) if words[i] != END][:s.symbols - 1]
    symbol = s.symbols + np.maximum(cls, 0)
    symbol[own] = 1 + np.arange(len(own))
    if END in words:
        symbol[words.index(END)] = 0
    class_n = np.array([sums.get(c, (0, 0))[0] for c in range(s.classes)], dtype=float)
    class_v = np.array([sums.get(c, (0, 0))[1] for c in range(s.classes)], dtype=float)
    np.subtract.at(class_n, cls[own], n[own])
    np.subtract.at(class_v, cls[own], 1)
    symbol_counts = np.zeros(s.symbols + s.classes)
    symbol_counts[0] = sums.get(-1, (0, 0))[0]
    symbol_counts[1:1 + len(own)] = n[own]
    symbol_counts[s.symbols:] = class_n
    return Vocabulary({w: i for i, w in enumerate(words)}, np.log10(n + SMOOTHING), symbol.astype(np.uint16),
                      symbol_counts, np.log10(class_n + SMOOTHING * (class_v + 1)),
                      int(sum(v[0] for v in sums.values())), int(sum(v[1] for v in sums.values())),
                      int(n[-1]) if len(n) else 0, s)


# -- symbols ------------------------------------------------------------------------------------

ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, log_own double, " \
          "log_other double, symbols binary, tail array<binary>"


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per document its symbols, the head words' log counts, and its words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        first, classes, get = v.settings.symbols, v.settings.classes, v.head.get
        row = TaskContext.get().partitionId() << 33
        end_known = END in v.head
        end_log = v.log_count[v.head[END]] if end_known else math.log10(SMOOTHING)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                out = []
                for text in part.column(2):
                    symbols, tail, known, log_own, log_other, tokens = [], [], 0, 0.0, 0.0, 0
                    for run in word_runs(text.as_py().translate(_LOWER)):
                        at = np.fromiter((get(w, -1) for w in run), np.int64, len(run))
                        outside = np.flatnonzero(at < 0)
                        inside = at[at >= 0] if len(outside) else at
                        found = np.empty(len(run), dtype=np.uint16)
                        sym, logs = v.symbol[inside], v.log_count[inside]
                        found[at >= 0] = sym
                        log_own += float(logs[sym < first].sum())
                        log_other += float(logs[sym >= first].sum())
                        if len(outside):
                            words = [run[i] for i in outside.tolist()]
                            found[outside] = [first + zlib.crc32(w[-3:]) % classes for w in words]
                            tail += words
                        symbols.append(found.tobytes())
                        known += len(inside)
                        tokens += len(run)
                    symbols.append(b"\0\0")
                    out.append((row, tokens + 1, known + end_known, log_own + end_log, log_other,
                                b"".join(symbols), tail))
                    row += 1
                column = lambda k, kind: pa.array([o[k] for o in out], type=kind)
                yield pa.RecordBatch.from_arrays(
                    [column(0, pa.int64()), part.column(0), part.column(1), column(1, pa.int64()),
                     column(2, pa.int64()), column(3, pa.float64()), column(4, pa.float64()), column(5, pa.binary()),
                     column(6, pa.list_(pa.binary()))], names=[f.split()[0] for f in ENCODED.split(", ")])

    return _texts(docs).mapInArrow(encode, ENCODED)


def _contexts(blobs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the documents one after another, and the one and two before each (``size``: none)."""
    lengths = np.array([len(b) // 2 for b in blobs])
    w = np.frombuffer(b"".join(blobs), dtype=np.uint16).astype(np.int64)
    one, two = np.roll(w, 1), np.roll(w, 2)
    starts = np.cumsum(lengths) - lengths
    one[starts] = size
    two[starts] = size
    seconds = starts[lengths > 1] + 1
    two[seconds] = size
    return w, one, two


# -- the model ----------------------------------------------------------------------------------

class LogBilinear:
    """Parameters: context vectors, a weight per position and component, symbol vectors, biases."""

    NAMES = ("context", "one", "two", "target", "bias")

    def __init__(self, size: int, width: int, counts: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        noise = np.maximum(counts, 0.5)
        self.noise = noise / noise.sum()
        self.context = rng.normal(0, 0.1, (size + 1, width))
        self.target = rng.normal(0, 0.1, (size, width))
        self.one, self.two = np.ones(width), np.full(width, 0.7)
        self.bias = np.log(self.noise)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at:at + old.size].reshape(old.shape).copy())
            at += old.size


def _summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by index, as a ``size`` x width matrix."""
    width = rows.shape[1]
    flat = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=size * width).reshape(size, width)


class Trainer:
    """Minibatches of noise-contrastive estimation with Adam; noise words are shared in a batch."""

    def __init__(self, model: LogBilinear, settings: ModelSettings, seed: int):
        self.m, self.s = model, settings
        self.rng = np.random.default_rng([settings.seed, seed])
        self.log_noise = np.log(model.noise) + math.log(settings.noise)
        self.edges = np.cumsum(model.noise)
        self.mean = {n: np.zeros_like(getattr(model, n)) for n in model.NAMES}
        self.square = {n: np.zeros_like(getattr(model, n)) for n in model.NAMES}
        self.steps = 0

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.m
        # evenly spaced draws from a random start: the noise distribution with little variance
        spaced = (np.arange(self.s.noise) + self.rng.random()) / self.s.noise
        drawn = np.searchsorted(self.edges, spaced * self.edges[-1])
        drawn = np.minimum(drawn, len(self.edges) - 1)
        x1, x2, target = m.context[one], m.context[two], m.target[w]
        q = x1 * m.one + x2 * m.two
        hit = np.einsum("ij,ij->i", q, target) + m.bias[w] - self.log_noise[w]
        miss = q @ m.target[drawn].T + (m.bias[drawn] - self.log_noise[drawn])
        up = 1 / (1 + np.exp(np.clip(hit, -30, 30)))                 # 1 - sigmoid: pull of the data
        down = 1 / (1 + np.exp(-np.clip(miss, -30, 30)))             # sigmoid: push of the noise
        g_q = up[:, None] * target - down @ m.target[drawn]
        n = len(w)
        size = len(m.target)
        grad = {
            "target": _summed(w, up[:, None] * q, size), "bias": np.bincount(w, weights=up, minlength=size),
            "context": _summed(one, g_q * m.one, size + 1) + _summed(two, g_q * m.two, size + 1),
            "one": (g_q * x1).sum(0), "two": (g_q * x2).sum(0)}
        np.subtract.at(grad["target"], drawn, down.T @ q)
        np.subtract.at(grad["bias"], drawn, down.sum(0))
        self.steps += 1
        rate = self.s.rate / math.sqrt(1 + self.steps / 200)
        for name, g in grad.items():
            g = g / n
            self.mean[name] += 0.1 * (g - self.mean[name])
            self.square[name] += 0.01 * (g * g - self.square[name])
            fix = (1 - 0.9 ** self.steps) / math.sqrt(1 - 0.99 ** self.steps)
            getattr(m, name)[...] += rate / fix * self.mean[name] / (np.sqrt(self.square[name]) + 1e-8)


def train(symbols: DataFrame, vocab: Vocabulary, partitions: int = 32) -> LogBilinear:
    """Averages what every task learns from its part of ``symbols`` (all of it, once)."""
    spark, s = symbols.sparkSession, vocab.settings
    counts = spark.sparkContext.broadcast(vocab.symbol_counts)
    size = vocab.size

    def fresh() -> LogBilinear:
        return LogBilinear(size, s.width, counts.value, s.seed)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model = fresh()
        trainer, seen, held = Trainer(model, s, part), 0, [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                new = _contexts(batch.column(0).slice(low, 256).to_pylist(), size)
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                whole = len(held[0]) // s.batch * s.batch
                for at in range(0, whole, s.batch):
                    trainer.step(*[x[at:at + s.batch] for x in held])
                seen += whole
                held = [x[whole:] for x in held]
        if len(held[0]):
            trainer.step(*held)
            seen += len(held[0])
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], type=pa.int64()), pa.array([(model.flat() * seen).tobytes()], type=pa.binary()),
                 pa.array([seen], type=pa.int64())], names=["part", "sums", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, part = 0.0, 0, -1
        for batch in batches:
            for at, sums, k in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                total, n, part = total + np.frombuffer(sums), n + k, max(part, at)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int64()), pa.array([total.tobytes()]),
                                              pa.array([n], type=pa.int64())], names=["part", "sums", "n"])

    schema = "part long, sums binary, n long"
    rows = (symbols.where("not held_out").select("symbols").mapInArrow(local, schema)
            .repartition(partitions, "part").mapInArrow(added, schema).collect())
    model = fresh()
    if rows:
        total = sum(np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["part"]))
        model.set_flat(total / sum(r["n"] for r in rows))
    return model


def normalisers(spark, model: LogBilinear) -> np.ndarray:
    """Log of the sum of all symbols' scores for every pair (two before, one before)."""
    size, shared = len(model.context), spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        near, target = (m.context * m.one).astype(np.float32), m.target.T.astype(np.float32)
        for batch in batches:
            out = []
            for two in batch.column(0).to_pylist():
                scores = (near + (m.context[two] * m.two).astype(np.float32)) @ target + m.bias.astype(np.float32)
                top = scores.max(axis=1, keepdims=True)
                out.append((np.log(np.exp(scores - top).sum(axis=1, dtype=np.float64)) + top[:, 0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["two", "logs"])

    got = spark.range(size).mapInArrow(rows, "two long, logs binary").collect()
    out = np.empty((size, size))
    for r in got:
        out[r["two"]] = np.frombuffer(r["logs"])
    return out


def model_scores(symbols: DataFrame, model: LogBilinear, vocab: Vocabulary) -> DataFrame:
    """``row, ln_symbols, class_space``: log-probability of each document's symbols, and the log10 of
    the totals that its class words share."""
    spark = symbols.sparkSession
    shared = spark.sparkContext.broadcast((
        ((model.context * model.one) @ model.target.T).astype(np.float32),
        ((model.context * model.two) @ model.target.T).astype(np.float32),
        model.bias, normalisers(spark, model).astype(np.float32), vocab.class_space, vocab.settings.symbols))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_t, two_t, bias, norm, space, first = shared.value
        size = len(bias)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                blobs = part.column(1).to_pylist()
                w, one, two = _contexts(blobs, size)
                logs = (one_t[one, w].astype(np.float64) + two_t[two, w] + bias[w] - norm[two, one])
                spaces = np.where(w >= first, space[np.maximum(w - first, 0)], 0.0)
                starts = np.cumsum([0] + [len(b) // 2 for b in blobs[:-1]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(logs, starts)),
                                                  pa.array(np.add.reduceat(spaces, starts))],
                                                 names=["row", "ln_symbols", "class_space"])

    return symbols.select("row", "symbols").mapInArrow(scored, "row long, ln_symbols double, class_space double")


# -- operator -----------------------------------------------------------------------------------

def language_model_scores(docs: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document."""
    counts = stored(token_counts(docs, settings.classes), "token-counts")
    vocab = vocabulary(counts, settings)
    symbols = stored(encoded(docs, vocab), "symbols")
    model = train(symbols, vocab)

    words = symbols.select("row", F.explode("tail").alias("word"))
    rare = counts.where(F.col("n") <= vocab.least_head).select("word", "n")
    tails = words.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTHING)).alias("log_tail"),
        F.count("n").alias("tail_known"))
    zero = F.lit(0.0)
    log_other = F.col("log_other") + F.coalesce("log_tail", zero)
    space = math.log10(vocab.tokens + SMOOTHING * (vocab.distinct + 1))
    facts = symbols.select("row", "doc_id", "held_out", "n_tokens", "head_known", "log_own", "log_other")
    return (facts.join(model_scores(symbols, model, vocab), "row").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("log_own") + log_other - F.col("n_tokens") * space).alias("base_score"),
        (F.col("ln_symbols") / math.log(10) - F.col("class_space") + log_other).alias("score")))
