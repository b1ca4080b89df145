"""Personal data: patterns find full forms, a skip-chain conditional random field finds their other mentions.

The patterns (email, ip, card, phone) give the base spans of a text, leftmost and non-overlapping per
kind; they always stay.  The same person's number or name often comes back in a form that no pattern
accepts: a phone without its country code, a card with odd separators, the name part of an email.

Skip-chain CRF.  The nodes are the *candidates* of a text: words with a digit or ``@``, and words that
equal the name part of one of its emails; every other word has the label "none".  A candidate's own
potential comes from its shape, its digits and its signs; neighbouring words share a transition
potential; and distant words that repeat or resemble each other share an agreement potential, by the
way they resemble (``SKIPS``).  Words of base spans are observed.  Loopy belief propagation
(sum-product, damped, a fixed number of rounds) passes labels along both kinds of edges, and a word
whose marginal reaches ``threshold`` joins the entity.  Of the words with one key each is linked to the
one before it, so edges grow with the words, not with their pairs.

Training.  All weights are learnt here, by regularised pseudo-likelihood, on a bounded sample of the
texts (about ``Settings.sample_texts`` texts of at most ``sample_chars`` characters, picked by their
hashes, up to ``sample_words`` candidates) into which generated entities, other mentions of them, and
look-alikes that are none (years, versions, part numbers, lone groups of a card) are written.  Words of the sample's own texts outside base spans are examples of "none".

Work per text is one task's; only the sample reaches the driver, and the weights (about 5,000
numbers) go out with the function.  Texts with neither a digit nor ``@`` have no candidate and are
not sent to Python at all.

Defined cases: a null or empty text has no spans; very long texts are handled whole, in time that grows
with their length (patterns are anchored so that long runs are read once); a null ``doc_id`` is kept;
repeated rows get equal results; a word in base spans of two kinds is observed as the first kind
listed; added spans never overlap base ones; an empty table gives no rows; other columns are
ignored, so none can clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SKIPS = ("same", "same, short", "same digits", "same last digits", "name part")
SPAN_SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"

# -- patterns -----------------------------------------------------------------------------------

_LOCAL = regex.compile(r"(?r)[A-Za-z0-9._%+-]+")                   # read backwards from the sign
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL.match(text, done, at)
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            done = domain.end()
            yield local.start(), done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the patterns' matches, by kind (index in ``KINDS``), then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _MARKED.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text)
                if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# -- graph of a text ----------------------------------------------------------------------------

@dataclass
class Graph:
    """Candidates of one or more texts and the edges between them."""

    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    observed: list[int] = field(default_factory=list)          # label, or -1
    features: list[tuple[int, ...]] = field(default_factory=list)
    left: list[int] = field(default_factory=list)              # 1 if the word before is no candidate
    right: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int, int]] = field(default_factory=list)   # two candidates and the kind of link


SIZES = (1024, 24, 12, 8, 8, 64, 2)       # values of each feature


def _sort_of(c: str) -> int:
    return 0 if c.isalpha() else 1 if c.isdigit() else 2 if c == "+" else 3 if c in "()" else 4 if c == "@" else 5


def word_features(word: str, digits: str) -> tuple[int, ...]:
    """The features of a candidate: shape, digits, letters, first and last sign, separators, Luhn."""
    shape = re.sub(r"[^\W\d_]+", "a", _DIGITS.sub("9", word[:64]))
    signs = sum(1 << i for i, s in enumerate("@.-(/:") if s in word)
    letters = len(word) - len(digits)
    return (zlib.crc32(shape.encode()) % SIZES[0], min(len(digits), SIZES[1] - 1), min(letters, SIZES[2] - 1),
            _sort_of(word[0]), _sort_of(word[-1]), signs, int(16 <= len(digits) <= 19 and luhn(digits)))


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """A word without signs at its edges (one that is all signs stays)."""
    word = text[a:b]
    inner = word.strip(_EDGE)
    if not inner:
        return a, b
    a += len(word) - len(word.lstrip(_EDGE))
    if "(" in inner and ")" not in inner and inner[0] == "(":
        return a + 1, a + len(inner)
    if ")" in inner and "(" not in inner and inner[-1] == ")":
        return a, a + len(inner) - 1
    return a, a + len(inner)


def _keys(word: str, digits: str) -> list[tuple[int, str]]:
    """``(kind of link, key)``: words that share one are linked."""
    low = word.casefold()
    plain = len(digits)
    out = [(0, low)] if len(low) >= 6 else [(1, low.strip("()"))] if plain >= 3 else []
    if plain >= 6:
        out.append((2, digits))
    if plain >= 7:
        out.append((3, digits[-7:]))
    return out


def add_text(graph: Graph, text: str, spans: list[tuple[int, int, int]]) -> None:
    """Adds the candidates of ``text``, whose base spans are ``spans``."""
    first = len(graph.start)
    names = {text[a:text.index("@", a)].casefold() for kind, a, _ in spans if kind == 0}
    names = {n for n in names if len(n) >= 4}
    marks = sorted((a, b, kind) for kind, a, b in spans)
    reach, low = [], 0                                         # largest end so far, to skip spans behind
    for a, b, _ in marks:
        low = max(low, b)
        reach.append(low)
    at, place, before = 0, -1, -2
    last: dict[tuple[int, str], int] = {}
    linked: set[tuple[int, int]] = set()
    for place, m in enumerate(_WORD.finditer(text)):
        marked = _MARKED.search(text, m.start(), m.end()) is not None
        if not marked and not names:
            continue
        a, b = _core(text, m.start(), m.end())
        word = text[a:b]
        if not marked and word.casefold() not in names:
            continue
        node = len(graph.start)
        while at < len(marks) and reach[at] <= m.start():
            at += 1
        own = [s for s in _until(marks, at, m.end()) if s[1] > m.start()]
        digits = "".join(_DIGITS.findall(word))
        graph.start.append(a)
        graph.end.append(b)
        graph.observed.append(1 + min(kind for _, _, kind in own) if own else -1)
        graph.features.append(word_features(word, digits))
        graph.left.append(int(place > 0 and before != place - 1))
        if before == place - 1:
            graph.chain.append((node - 1, node))
        elif node > first:
            graph.right[-1] = 1
        graph.right.append(0)
        before = place
        whole = next((text[x:y] for x, y, _ in own if y <= m.end()), None)     # a span's last word stands for it
        keys = _keys(word, digits if whole is None else "".join(_DIGITS.findall(whole)))
        if names:
            name = word.casefold().partition("@")[0]
            if name in names:
                keys.append((4, name))
        for key in keys:
            earlier = last.get(key)
            if earlier is not None and (earlier, node) not in linked:
                linked.add((earlier, node))
                graph.skip.append((earlier, node, key[0]))
            last[key] = node
    if len(graph.start) > first and before != place:
        graph.right[-1] = 1


def _until(marks: list[tuple[int, int, int]], at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < len(marks) and marks[at][0] < end:
        yield marks[at]
        at += 1


# -- model --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """Weights by label: a table for each feature, transitions, and agreement for each kind of link."""

    own: tuple[np.ndarray, ...]
    bias: np.ndarray
    next: np.ndarray
    agree: np.ndarray


@dataclass(frozen=True)
class Settings:
    sample_texts: int = 600        # texts that the weights are learnt on
    sample_chars: int = 20_000     # longest text of the sample
    sample_words: int = 60_000     # candidates after which no more texts are taken
    seed: int = 7
    steps: int = 400               # of gradient descent
    penalty: float = 0.3
    rounds: int = 30               # of message passing
    damping: float = 0.5
    threshold: float = 0.8


def _own_scores(model: Model, features: np.ndarray) -> np.ndarray:
    return model.bias + sum(w[features[:, k]] for k, w in enumerate(model.own))


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=rows[:, y], minlength=n) for y in range(rows.shape[1])], axis=1)


def _log_sum(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(scores - top).sum(axis=axis))


EDGES_AT_ONCE = 1 << 17


def marginals(scores: np.ndarray, edges: np.ndarray, kinds: np.ndarray, potentials: np.ndarray, rounds: int,
              damping: float) -> np.ndarray:
    """Label probabilities by loopy belief propagation.  ``scores[node, label]`` are own log potentials,
    ``potentials[kind, label of first, label of second]`` those of the ``edges`` ``(first, second)``."""
    n, labels = scores.shape
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([potentials[kinds], potentials[kinds].transpose(0, 2, 1)]) if len(edges) * labels < EDGES_AT_ONCE else None
    both = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    which = np.concatenate([kinds, kinds + len(potentials)])
    message = np.zeros((len(source), labels))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    for _ in range(rounds if len(edges) else 0):
        belief = scores + _sum_by(target, message, n)
        new = np.empty_like(message)
        for low in range(0, len(source), EDGES_AT_ONCE):
            part = slice(low, low + EDGES_AT_ONCE)
            out = belief[source[part]] - message[back[part]]
            pair = table[part] if table is not None else both[which[part]]
            new[part] = _log_sum(out[:, :, None] + pair, 1)
        new -= _log_sum(new, 1)[:, None]
        message = damping * message + (1 - damping) * new
    belief = scores + _sum_by(target, message, n) if len(edges) else scores
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def infer(graph: Graph, model: Model, settings: Settings) -> np.ndarray:
    """Marginals of all candidates of the graph."""
    n = len(graph.start)
    scores = _own_scores(model, np.array(graph.features, dtype=np.int64).reshape(n, len(SIZES)))
    scores = scores + np.array(graph.left)[:, None] * model.next[0] + np.array(graph.right)[:, None] * model.next[:, 0]
    observed = np.array(graph.observed)
    seen = observed >= 0
    scores[seen] = -60.0
    scores[seen, observed[seen]] = 0.0
    potentials = np.concatenate([model.next[None], np.stack([np.diag(a) for a in model.agree])])
    edges = np.array([e for e in graph.chain] + [e[:2] for e in graph.skip], dtype=np.int64).reshape(-1, 2)
    kinds = np.array([0] * len(graph.chain) + [1 + e[2] for e in graph.skip], dtype=np.int64)
    return marginals(scores, edges, kinds, potentials, settings.rounds, settings.damping)


# -- training -----------------------------------------------------------------------------------

def fit(graph: Graph, gold: np.ndarray, settings: Settings) -> Model:
    """Weights that maximise the penalised pseudo-likelihood of the unobserved candidates' labels."""
    n, labels = len(graph.start), len(LABELS)
    features = np.array(graph.features, dtype=np.int64).reshape(n, len(SIZES))
    free = (np.array(graph.observed) < 0).nonzero()[0]
    one = np.eye(labels)[gold]
    before, after = np.zeros((n, labels)), np.zeros((n, labels))
    before[np.array(graph.left) == 1, 0] = 1
    after[np.array(graph.right) == 1, 0] = 1
    for i, j in graph.chain:
        after[i], before[j] = one[j], one[i]
    agree = np.zeros((len(SKIPS), n, labels))
    for i, j, kind in graph.skip:
        agree[kind, i] += one[j]
        agree[kind, j] += one[i]
    features, before, after, agree, wanted = features[free], before[free], after[free], agree[:, free], one[free]
    model = [*(np.zeros((s, labels)) for s in SIZES), np.zeros(labels), np.zeros((labels, labels)),
             np.zeros((len(SKIPS), labels))]
    speed, square = [np.zeros_like(w) for w in model], [np.zeros_like(w) for w in model]
    for step in range(1, settings.steps + 1):
        own, bias, move, link = model[:len(SIZES)], *model[len(SIZES):]
        scores = bias + sum(w[features[:, k]] for k, w in enumerate(own)) + before @ move + after @ move.T \
            + np.einsum("tny,ty->ny", agree, link)
        miss = np.exp(scores - _log_sum(scores, 1)[:, None]) - wanted
        slopes = [*(_sum_by(features[:, k], miss, s) for k, s in enumerate(SIZES)), miss.sum(axis=0),
                  before.T @ miss + miss.T @ after, np.einsum("tny,ny->ty", agree, miss)]
        for w, s, v, q in zip(model, slopes, speed, square, strict=True):      # Adam
            s = s + settings.penalty * w
            v += 0.1 * (s - v)
            q += 0.01 * (s * s - q)
            w -= 0.05 * (v / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)
    return Model(tuple(model[:len(SIZES)]), *model[len(SIZES):])


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _entity(rng: np.random.Generator, kind: int) -> tuple[str, list[str], list[str]]:
    """A generated entity: its full form, other mentions of it, and look-alikes that are none."""
    if kind == 0:
        letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 9)))
        name = letters + rng.choice(["", f".{_digits(rng, 2)}", f"_{_digits(rng, 3)}", f".{letters[::-1]}"])
        host = f"{rng.choice(['mail', 'post', 'box'])}{_digits(rng, 1)}.example.{rng.choice(['com', 'org', 'net'])}"
        return f"{name}@{host}", [name, f"{name}(at){host}", name.upper()], [host, f"{letters[:3]}{_digits(rng, 2)}", f"@{letters[:2]}"]
    if kind == 1:
        parts = [str(p) for p in rng.integers(1, 256, 4)]
        return ".".join(parts), ["-".join(parts), "[.]".join(parts)], [".".join(parts[:2]), parts[0], f"v{parts[1]}.{parts[2]}"]
    if kind == 2:
        body = rng.choice(["4", "5"]) + _digits(rng, 14)
        card = body + next(c for c in "0123456789" if luhn(body + c))
        groups = [card[i:i + 4] for i in range(0, 16, 4)]
        return rng.choice([card, " ".join(groups), "-".join(groups)]), \
            [".".join(groups), "/".join(groups), "_".join(groups), card + "x"], [groups[1], _digits(rng, 16), _digits(rng, 12)]
    area, mid, end = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    full = rng.choice([f"+1 ({area}) {mid}-{end}", f"+1-{area}-{mid}-{end}", f"+1 {area} {mid} {end}"])
    return full, [f"({area}) {mid}-{end}", f"{mid}-{end}", f"{area}-{mid}-{end}", f"1-{area}-{mid}-{end}", f"{area}.{mid}.{end}"], \
        [area, end, f"{_digits(rng, 3)}-{_digits(rng, 4)}", _digits(rng, 10)]


def _look_alikes(rng: np.random.Generator) -> list[str]:
    """Words with digits that are no one's data."""
    key = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ234567"), rng.integers(8, 33)))
    code = "".join(rng.choice(list("0123456789abcdef"), rng.integers(4, 41)))
    return [key, code, f"{code[:4]}.{key[:5].lower()}", str(rng.integers(1900, 2100)), f"{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}",
            f"${rng.integers(1, 999)}.{_digits(rng, 2)}", f"#{_digits(rng, 5)}", f"AB{_digits(rng, 6)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}",
            _digits(rng, 8), f"({_digits(rng, 3)})", f"({rng.integers(1900, 2100)})", f"{_digits(rng, 4)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"x{_digits(rng, 1)}", f"v{_digits(rng, 1)}.{_digits(rng, 1)}.{_digits(rng, 1)}"]


def practice_text(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with generated entities, other mentions of them and look-alikes between its words; and
    ``(label, start, end)`` of the other mentions."""
    pieces: list[tuple[str, int]] = []
    for kind in rng.permutation(len(KINDS))[:rng.integers(1, 4)]:
        full, mentions, others = _entity(rng, int(kind))
        pieces.append((full, 0))
        pieces += [(str(m), int(kind) + 1) for m in rng.choice(mentions, rng.integers(1, 3), replace=False)]
        pieces += [(str(o), 0) for o in rng.choice(others, rng.integers(0, 3), replace=False)]
    pieces += [(str(o), 0) for o in rng.choice(_look_alikes(rng), 6, replace=False)]
    own = text.split(" ")
    places = rng.integers(0, len(own) + 1, len(pieces))
    written, gold, length = [], [], 0
    order = np.argsort(places, kind="stable")
    at = 0
    for k in order:
        run = own[at:places[k]]
        at = max(at, int(places[k]))
        for word in [*run, "so"]:               # a plain word keeps two pieces apart
            written.append(word)
            length += len(word) + 1
        piece, label = pieces[k]
        if label:
            gold.append((label, length, length + len(piece)))
        piece += str(rng.choice(["", "", ".", ","]))
        written.append(piece)
        length += len(piece) + 1
    return " ".join(written + own[at:]), gold


def train(texts: list[str], settings: Settings = Settings()) -> Model:
    """The model learnt on ``texts`` with written-in entities."""
    rng = np.random.default_rng(settings.seed)
    graph, gold = Graph(), []
    for text in texts or [""]:
        if len(gold) >= settings.sample_words:
            break
        full, mentions = practice_text(text, rng)
        first = len(graph.start)
        add_text(graph, full, base_spans(full))
        for a, b, seen in zip(graph.start[first:], graph.end[first:], graph.observed[first:], strict=True):
            gold.append(seen if seen >= 0 else next((k for k, x, y in mentions if x < b and a < y), 0))
    return fit(graph, np.array(gold, dtype=np.int64), settings)


def sample(docs: DataFrame, settings: Settings = Settings()) -> list[str]:
    """The texts the model is learnt on, about ``sample_texts``: those with a candidate and of bounded
    length whose hashes fall below a share of their range, each text once.  Tasks send nothing else."""
    text = F.col("text")
    rows = docs.select("text").where(text.rlike("[0-9@]") & (F.char_length(text) <= settings.sample_chars))
    n = rows.count()
    share = min(1.0, settings.sample_texts / max(n, 1))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), "text"), 11)
    few = rows.where(place < F.lit(int(share * (1 << 53)))).distinct()
    return [r["text"] for r in few.orderBy(place, "text").limit(2 * settings.sample_texts).collect()]


# -- operator -----------------------------------------------------------------------------------

def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model,
                settings: Settings) -> list[list[tuple[int, int, int]]]:
    """``(kind, start, end)`` that the field adds to each text."""
    graph, bounds = Graph(), [0]
    for text, spans in zip(texts, bases, strict=True):
        add_text(graph, text, spans)
        bounds.append(len(graph.start))
    if not graph.start:
        return [[] for _ in texts]
    found = infer(graph, model, settings)
    label = found.argmax(axis=1)
    label[found.max(axis=1) < settings.threshold] = 0
    label[np.array(graph.observed) >= 0] = 0
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    joined = {j for _, j in graph.chain}
    hits = np.flatnonzero(label)
    owner = np.searchsorted(bounds, hits, side="right") - 1
    for node, t in zip(hits.tolist(), owner.tolist(), strict=True):
        kind, a, b = int(label[node]) - 1, graph.start[node], graph.end[node]
        spans = out[t]
        if node in joined and spans and spans[-1][0] == kind and label[node - 1] == label[node] \
                and texts[t][spans[-1][2]:a] == " ":
            spans[-1] = (kind, spans[-1][1], b)
        else:
            spans.append((kind, a, b))
    return [sorted(s) for s in out]


def personal_data(docs: DataFrame, model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, spans`` for every row: spans (kind, start, end in code points, whether a pattern found
    it) by kind as listed in ``KINDS``, then start."""
    model = model or train(sample(docs, settings), settings)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for batch in batches:
            column = batch.column(1)
            texts = [t.as_py() or "" for t in column]
            bases = [base_spans(t) if t else [] for t in texts]
            more = added_spans(texts, bases, model, settings)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in
                     sorted([(*s, True) for s in base] + [(*s, False) for s in extra])]
                    for base, extra in zip(bases, more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(kind))], names=["doc_id", "spans"])

    text = F.col("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    return slim.mapInArrow(find, SPAN_SCHEMA)


def span_digests(rows: DataFrame) -> DataFrame:
    """Per row: base spans by kind, the digest of all base spans, and all spans as text."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                       listed(F.col("spans")).alias("spans"))
