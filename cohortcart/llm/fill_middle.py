"""Fill-in-the-middle: cut each text in three at unit borders and write the middle last.

Repeated-capture matching.  A text is matched once, whole, against ``(unit)*``; the regex library
keeps every repetition of the group, so ``match.ends(1)`` lists the end of each unit.  Its length is
the number of units, and the two cut offsets are looked up in it: no loop over units or characters.
A unit is one code point unless another pattern is given (words with their blanks, lines, ...).

The draws that place the cuts and choose the form come from a SHA-256 digest of the seed and the
document's id, computed by Spark's own functions, so neither partitions nor retries change a result.
``restore`` rebuilds the text from ``output`` and ``form`` alone, also by Spark's functions: the marks
begin with a character that occurs nowhere else in them, and only texts without marks are cut, so
the first mark found is the one written.

Every row is handled on its own, in the order it comes; nothing is shuffled.  A text takes about 130
bytes a character of a task's memory while it is matched.

Defined cases: a null text is empty; an empty text, a text that holds a mark, and a text that
``(unit)*`` does not cover whole are left plain (``n`` is 0 for the last kind); very long texts are
matched whole; a null ``doc_id`` draws from the seed alone; rows with the same id get the same
draws, repeated rows equal results; an empty table gives no rows; other columns are ignored, so none
can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90            # of 100: draws from here on leave the text plain
SUFFIX_FIRST = 20          # of 100: draws below put the suffix first
SEED = 1
SLICE_BYTES = 8 << 20      # texts sent on together

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four integers of 32 bits from the SHA-256 digest of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(text: str, units: regex.Pattern, h: tuple[int, int, int, int],
                plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text; ``units`` matches ``(unit)*``."""
    match = units.fullmatch(text)
    ends = match.ends(1) if match else []
    n = len(ends)
    if not text or not match or h[2] % 100 >= plain_from or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of slices that hold ``SLICE_BYTES`` of text or little more."""
    low, held = 0, 0
    sizes = pc.binary_length(texts).to_pylist()
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE_BYTES or i == len(sizes) - 1:
            yield low, i + 1 - low
            low, held = i + 1, 0


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED, plain_from: int = PLAIN_FROM,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*")
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                            ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            for low, rows in _slices(batch.column(1)):
                part = batch.slice(low, rows)
                numbers = zip(*[c.to_pylist() for c in part.columns[2:]], strict=True)
                made = [transformed(t.as_py(), units, h, plain_from, suffix_first)
                        for t, h in zip(part.column(1), numbers, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, type=f.type) for c, f in
                                       zip(zip(*made, strict=True), list(schema)[1:], strict=True))], schema=schema)

    doc_id = F.col("doc_id").cast("long")
    named = [h.alias(f"h{i}") for i, h in enumerate(draws(doc_id, seed), 1)]
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *named).mapInArrow(cut, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from the output and the form."""
    def between(first: str, last: str) -> Column:
        begin = F.locate(first, output) + len(first)
        return output.substr(begin, F.locate(last, output) - begin)

    after = output.substr(F.locate(MIDDLE, output) + len(MIDDLE), F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """The rows with SHA-256 digests in the place of the texts."""
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB twin of ``digests(fill_in_middle(documents))``."""
    h = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
               FROM documents),
drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {h} FROM texts),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR h3 % 100 >= {PLAIN_FROM} OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}')
              OR contains(t, '{MIDDLE}') THEN 'plain'
         WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
