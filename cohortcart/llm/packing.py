"""Packing: tokenise documents, lay all tokens end to end, cut at fixed windows.

Concatenate and cut.  The first pass tokenises every text once and stores, per document, its ids
and its start within its task's output, so each task's token total is known.  The second pass
turns the task totals into base offsets (a prefix sum over one row per task), which gives every
document its global offset; documents are then cut at multiples of the window length.  A document
that crosses a window border leaves one record on either side of it.  Only the very last sequence
can need padding.  No record is shuffled: the second pass is a scan with a broadcast of one row per
task of the first (the number of tasks, not of documents, bounds it).

The token table is written under the session's shared checkpoint directory, so a lost executor
costs a re-read; a re-run task tokenises the same rows in the same order.

Defined cases: a null text is empty; an empty text is the end id alone; repeated rows are packed
as often as they come; a null ``doc_id`` is kept as null; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortcart.session import stored

SEQUENCE_LENGTH = 2048
END_ID = 1
CACHE_WORDS = 200_000        # parts of words a Python worker remembers the ids of; then it starts afresh
LONGEST_KEPT = 100           # characters of a remembered word
SLICE_BYTES = 4 << 20        # texts tokenised together, so that their new words are learnt once
SEGMENT_CHARS = 1 << 20      # texts are tokenised in segments of about this length, cut at blanks

_SPLIT_ONLY_PYTHON = re.compile("[\x1c-\x1f]")   # str.split() cuts here, the tokenizer does not
_TAIL = ".,;:!?*#%$&|"
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]))
_PLAIN = f"^[{_LETTERS}]+$"     # words of these letters are handled by Arrow, any others by Python
_LATIN_END = "\u0250"          # letters below it lower-case one by one and have no other normal form


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself,
    the other bytes take the characters from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()

TOKEN_SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids binary"


def _letters_only(part: str) -> bool:
    """Whether the tokenizer sees letters alone: some letters are written as a letter and a combining
    mark in lower case or normal form, and a mark is cut off differently."""
    return part.isalpha() and (part.isascii() or unicodedata.normalize("NFC", part).lower().isalpha())


class WordEncoder:
    """Token ids of texts, found per distinct blank-separated word of a slice.

    Arrow splits the texts, finds the distinct words, and of these the distinct lower-case cores and
    tails; Python sees each of those once and remembers the ids.  Valid for byte-pair tokenizers that
    drop white space, lower-case, and cut at letters, digits and signs, such as the default one; the
    tests compare it with whole-text encoding."""

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _core(self, letters: str) -> bytes:
        """Ids of lower-case Latin letters: one piece to the tokenizer, so they go to its merges directly."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part of a word; all but lower-case Latin letters go through the whole tokenizer."""
        if part.isalpha() and max(part) < _LATIN_END and part == part.lower():
            return self._core(part)
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of any word.  Letters followed by ASCII signs are two separate pieces to the tokenizer
        where they are still letters in its normal form, and letters are lower-cased first; any other
        word goes through it whole.  Blanks other than ASCII ones separate words here."""
        out = []
        for w in [word] if _SPLIT_ONLY_PYTHON.search(word) else word.split():
            core = w.rstrip(_TAIL)
            if _letters_only(core):
                low = core.lower()
                out += [self._part(low if max(low) < _LATIN_END else core), self._part(w[len(core):])]
            else:
                out.append(self._part(w))
        return b"".join(out)

    def _known(self, pieces: list[str], learn) -> list[bytes]:
        """Ids of the pieces, remembered; ``learn`` gives those of a new one.  Long ones are not kept."""
        found = list(map(self.known.get, pieces))
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = learn(pieces[i])
                if len(pieces[i]) <= LONGEST_KEPT:
                    self.known[pieces[i]] = x
        return found

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and where those of each begin and end."""
        core = pc.utf8_rtrim(words, characters=_TAIL)
        plain = pc.match_substring_regex(core, _PLAIN)
        rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        others = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        cores = pc.utf8_lower(core.take(pa.array(rows))).dictionary_encode()
        tails = pc.utf8_ltrim(words.take(pa.array(rows)), characters=_LETTERS).dictionary_encode()
        ids = [b"", *self._known(cores.dictionary.to_pylist(), self._core),
               *self._known(tails.dictionary.to_pylist(), self._word),
               *self._known(words.take(pa.array(others)).to_pylist(), self._word)]
        # two pieces a word: core and tail, or the word and nothing
        pieces = np.zeros((len(words), 2), dtype=np.int64)
        pieces[rows, 0] = cores.indices.to_numpy() + 1
        pieces[rows, 1] = tails.indices.to_numpy() + 1 + len(cores.dictionary)
        pieces[others, 0] = np.arange(len(others)) + len(ids) - len(others)
        values, bounds = _laid_out(_lists(ids), pieces.ravel())
        return values, bounds[::2]

    def encode_slice(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end with ``end`` after each, and where those of each begin and end."""
        if len(self.known) > self.cache_words:
            self.known = {}
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        values, bounds = self._distinct(words.dictionary)
        values = np.concatenate([values, np.asarray(end, dtype="<u4")])
        lists = pa.ListArray.from_arrays(pa.array(np.append(bounds, len(values)), type=pa.int32()), pa.array(values))
        until = np.cumsum(pc.list_value_length(split).to_numpy())
        order = np.insert(words.indices.to_numpy(), until, len(words.dictionary))
        ids, at = _laid_out(lists, order)
        return ids, at[np.concatenate([[0], until + np.arange(1, len(until) + 1)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_slice(pa.array(texts, type=pa.string()))
        return [ids[low:high].tobytes() for low, high in zip(at[:-1], at[1:], strict=True)]


def _lists(ids: list[bytes]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)])
    return pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))


def _laid_out(lists: pa.ListArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``lists`` in ``order``, end to end, and where those of each begin and end."""
    taken = lists.take(pa.array(order))
    bounds = taken.offsets.to_numpy()
    return taken.flatten().to_numpy(), bounds - bounds[0]


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """``text`` in pieces of at least ``limit`` characters, each cut at a space."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of slices with at most ``SLICE_BYTES`` of text, or one longer text."""
    sizes, low, held = pc.binary_length(texts).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > low and held + size > SLICE_BYTES:
            yield low, i - low
            low, held = i, 0
        held += size
    if sizes:
        yield low, len(sizes) - low


def _encoded(encoder: WordEncoder, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
    """Ids of each text of a slice with ``end_id`` after them, and where those of each begin and end.  A
    text that fills a slice alone is encoded by segments."""
    if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > SLICE_BYTES:
        parts = [encoder.encode_slice(pa.array([p]))[0] for p in segments(texts[0].as_py())]
        ids = np.concatenate([*parts, np.asarray([end_id], dtype="<u4")])
        bounds = np.asarray([0, len(ids)])
    else:
        ids, bounds = encoder.encode_slice(texts, (end_id,))
    places = pa.py_buffer(np.ascontiguousarray(bounds * 4, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, places, pa.py_buffer(np.ascontiguousarray(ids))]), bounds


def token_table(docs: DataFrame, tokenizer_path: str | Path, end_id: int = END_ID) -> DataFrame:
    """First pass: ids of every document (end id included) and its start within its task's output."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            column = batch.column(1)
            for low, rows in _slices(column):
                ids, bounds = _encoded(encoder, column.slice(low, rows), end_id)
                starts = at + bounds.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, part, dtype=np.int32)), pa.array(starts[:-1]),
                     batch.column(0).slice(low, rows), pa.array(np.diff(starts)), ids],
                    names=["part", "local_start", "doc_id", "n_tokens", "ids"])
                at = int(starts[-1])
        # an idle worker waits beside the next stage's tasks, so it keeps the tokenizer only
        encoder.known = {}
        pa.default_memory_pool().release_unused()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tokenise, TOKEN_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str | Path, length: int = SEQUENCE_LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """Pieces: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (``ids`` as
    little-endian unsigned 32-bit integers).  ``start`` counts the document's ids before the piece,
    ``offset`` the sequence's ids before it."""
    tokens = stored(token_table(docs, tokenizer_path, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("local_start"))
    first = F.expr(f"at div {length}")
    last = F.expr(f"(at + n_tokens - 1) div {length}")
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("sequence_id") * length - F.col("at"), F.lit(0))
    until = F.least((F.col("sequence_id") + 1) * length - F.col("at"), F.col("n_tokens"))
    cut = cut.withColumn("start", begin).withColumn("length", until - F.col("start"))
    return cut.select(
        "doc_id", "start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
        F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"))


def sequences(pieces: DataFrame, length: int = SEQUENCE_LENGTH, pad_id: int = 0) -> DataFrame:
    """Whole sequences ``sequence_id, ids`` (binary, ``length`` ids, the last one padded).

    A piece that fills its window is a sequence already; only boundary records are shuffled, and
    each group of them holds at most ``length`` ids."""
    whole = pieces.where(F.col("length") == length).select("sequence_id", "ids")
    rest = (pieces.where(F.col("length") < length).groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")))
    pad = F.lit(np.full(length, pad_id, dtype="<u4").tobytes())
    return whole.unionByName(rest).select(
        "sequence_id", F.substring(F.concat(F.col("ids"), pad), F.lit(1), F.lit(4 * length)).alias("ids"))
