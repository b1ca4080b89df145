import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from cohortcart.llm.fill_middle import CODE_POINT, MARKS, digests, fill_in_middle, restore, transformed
from tests.llm import odd

UNITS = regex.compile(f"({CODE_POINT})*")


def expected(doc_id, text):
    """The contract, by plain slicing."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def special_rows():
    rng = random.Random(3)
    texts = ["a <M> b", "<P>", "almost <P or M> <", "<", "<<<<", ">S<", "P>x<S", "é \U0001f926‍   \r\n", "\x00\x01",
             "".join(rng.choice("<>PSM ab\n") for _ in range(300))]
    return [(1000 + i, texts[i % len(texts)], "en", "s", 1) for i in range(40 * len(texts))]


def test_rows_equal_brute_force_with_odd_cases(spark):
    docs = odd.documents(spark, clash=True).unionByName(
        spark.createDataFrame(special_rows(), odd.SCHEMA), allowMissingColumns=True)
    made = fill_in_middle(docs)
    rows = made.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = sorted((odd.key((r[0], *expected(r[0], r[1]), r[1] or "")) for r in odd.rows() + special_rows()))
    assert sorted(odd.key(r) for r in rows) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_results_do_not_depend_on_partitions(spark):
    docs = odd.documents(spark)
    one, other = (sorted(map(odd.key, digests(fill_in_middle(d)).collect())) for d in (docs, docs.repartition(11)))
    assert one == other


def test_every_repetition_is_kept():
    assert UNITS.fullmatch("ab\nc").ends(1) == [1, 2, 3, 4]
    n, form, a, m, out = transformed("abcdef", UNITS, (1, 4, 0, 50))
    assert (n, form, a, m, out) == (6, "psm", 1, 3, "<P>a<S>ef<M>bcd")
    assert transformed("abcdef", UNITS, (4, 1, 0, 10)) == (6, "spm", 1, 3, "<S>ef<P>a<M>bcd")
    assert transformed("abcdef", UNITS, (0, 6, 0, 50)) == (6, "psm", 0, 6, "<P><S><M>abcdef")
    assert transformed("abcdef", UNITS, (7, 0, 89, 50)) == (6, "psm", 0, 0, "<P><S>abcdef<M>")
    assert transformed("abcdef", UNITS, (1, 4, 90, 50)) == (6, "plain", None, None, "abcdef")


def test_other_units(spark):
    text = "one two  three\nfour"
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i in range(50)] + [(99, " blank first", "en", "s", 1)], odd.SCHEMA)
    rows = fill_in_middle(docs, unit=r"\S+\s*")
    rows = rows.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    borders = {0, 4, 9, 15, 19}
    for r in rows:
        if r["doc_id"] == 99:                       # the units do not cover the leading blank
            assert (r["n"], r["form"], r["output"]) == (0, "plain", " blank first")
            continue
        assert r["back"] == text and r["n"] == 4
        if r["form"] != "plain":
            assert r["prefix_chars"] in borders and r["prefix_chars"] + r["middle_chars"] in borders


def test_empty_table(spark):
    assert digests(fill_in_middle(odd.empty(spark))).count() == 0


@pytest.mark.parametrize("length", [0, 1, 200_000])
def test_very_long_texts(length):
    text = "é" * length
    n, form, a, m, out = transformed(text, UNITS, (7, 3, 0, 99))
    assert n == length and out.replace("<P>", "").replace("<S>", "").replace("<M>", "") == text


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op13_fill_middle, table

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in table(spark, sf, "documents").collect():
        n, form, a, m, out = expected(r["doc_id"], r["text"])
        want[r["doc_id"]] = (n, form, a, m, hashlib.sha256(out.encode()).hexdigest(),
                             hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in op13_fill_middle(spark, sf).collect()}
    assert got == want
