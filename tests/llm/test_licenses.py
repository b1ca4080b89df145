from cohortcart.llm import licenses
from tests.harness import compare, duck
from tests.llm import odd


def grams(text):
    return set(licenses.template_bigrams(text))


def test_lines_and_whole_texts(spark):
    mit = licenses.TEMPLATES["MIT opening"]
    half = mit.index(" ", len(mit) // 2)
    texts = [(1, "prose here\nReleased under the MIT License.\nmore of it"), (2, mit[:half] + "\n" + mit[half:]),
             (3, "RELEASED -- under  the mit license"), (4, "Released under the BSD License maybe, who knows it at all"),
             (5, None), (6, ""), (7, "one"), (1, "prose here\nReleased under the MIT License.\nmore of it")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' AS line", "'y' AS unit")
    got = sorted((r["doc_id"], r["line"], r["license"], r["dice"]) for r in licenses.scan_licenses(docs).collect())
    assert got == [(1, 1, "MIT notice", 1.0), (1, 1, "MIT notice", 1.0), (2, -1, "MIT opening", 1.0),
                   (3, 0, "MIT notice", 1.0)]


def test_size_bounds_drop_no_match(spark):
    """Every unit against every template, without bounds."""
    words = "released under the mit license and some more words of any kind at all".split()
    texts = [(i * 20 + j, " ".join(words[i:j])) for i in range(6) for j in range(i + 1, len(words) + 1)]
    templates = {"a": "released under the MIT license", "b": "the MIT license and some more words", "tie": "Released, under the MIT license!"}
    got = {r["doc_id"]: (r["license"], r["dice"]) for r in licenses.scan_licenses(
        spark.createDataFrame(texts, "doc_id long, text string"), templates, threshold=0.5).collect()}
    want = {}
    for i, t in texts:
        g = grams(t)
        best = sorted((-2 * len(g & grams(x)) / (len(g) + len(grams(x))), n) for n, x in templates.items())
        if g and -best[0][0] >= 0.5:
            want[i] = (best[0][1], -best[0][0])
    assert got == want


def test_licences_that_are_no_line_of_their_own(spark):
    import textwrap

    code = "\n".join(f"x{i} = compute(y{i}, z{i})" for i in range(60))
    header = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES["Apache-2.0 header"], 76))
    texts = [(1, "#!/bin/sh\n" + header + "\n" + code),
             (2, "Copyright 2020 Foo. Released under the MIT License. See LICENSE."), (3, "Licensed under the MIT License."),
             (4, code + "\n" + licenses.WINDOW_TEMPLATES["MIT text"].replace(", ", ",\n") + "\n" + code),
             (5, code), (6, None), (7, "a\nReleased under the MIT License.\nb"), (8, "of the software " * 3000)]
    got = sorted((r["doc_id"], r["line"], r["license"], r["dice"]) for r in licenses.find_licenses(
        spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(1, 1, "Apache-2.0 header", 1.0), (2, 0, "MIT notice", 1.0), (3, 0, "MIT licensed", 1.0),
                   (4, 60, "MIT text", 1.0), (7, 1, "MIT notice", 1.0)]


def test_odd_and_empty_tables(spark):
    assert licenses.scan_licenses(odd.documents(spark, clash=True)).count() == 0
    assert licenses.scan_licenses(odd.empty(spark)).count() == 0


def test_query_equals_oracle(spark):
    from cohortcart.llm.queries import op6_licenses, oracle_sql

    sf = "/root/testdata/sf0.001"
    assert compare(op6_licenses(spark, sf), oracle_sql()["op6_licenses"], duck(sf))["ok"]
