import base64
import hashlib
import random

import pytest

from cohortcart.llm.warc import page_records, read_archives, write_archives
from cohortcart.session import scratch_path
from tests.llm import odd

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        kind = rng.randrange(8)
        html = ["a" * rng.randint(0, 3000), FAKE * rng.randint(1, 9), "x WARC/1.0\r\n y", None, "", "é" * 50 + FAKE + "tail" * 20,
                str(i) * 40, "WARC/1.0\r\n"][kind]
        out.append((i, f"http://x/{i}", html))
    out += [(None, None, "null id"), (5000, "u\r\nWARC-Type: fake", "null id"), (None, "q", "alone"), (-4, "q", ""),
            (6000, "long", FAKE.join(["z" * 20_000] * 20)), out[6], out[6]]
    return out


def expected(pages):
    ids = {}
    for i, _, html in pages:
        ids.setdefault(html or "", []).append(i)
    for i, _, html in pages:
        data = (html or "").encode()
        known = [x for x in ids[html or ""] if x is not None]
        first = min(known, default=None)
        again = first is not None and i != first
        yield (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
               "revisit" if again else "response", first if again else None)


@pytest.mark.parametrize("block", ["3k", "64k", "128m"])
def test_round_trip_whatever_the_splits(spark, block):
    path = scratch_path(spark, "warc-test")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        pages = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr(
            "*", "'a' AS digest", "'b' AS size", "'c' AS payload", "'d' AS first").repartition(3)
        write_archives(pages, path)
        got = page_records(read_archives(spark, path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(odd.key, got)) == sorted(map(odd.key, expected(rows())))


def test_archives_are_plain_warc(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(spark.createDataFrame([(1, "http://u", "<p>é</p>")], "page_id long, url string, html string"), path)
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    assert text.startswith("WARC/1.0\r\nWARC-Type: response\r\n") and text.endswith("<p>é</p>\r\n\r\n")


@pytest.mark.parametrize("block", ["3k", "128m"])
def test_urls_of_any_length(spark, block):
    pages = [(i, f"http://x/{i}", f"page {i}") for i in range(20)]
    pages += [(100, "data:text/plain," + "u" * 100_000, "long url"), (101, "q" + " " * 100_000 + "q", FAKE), (102, "http://x", "last")]
    path = scratch_path(spark, "warc-test")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
        got = page_records(read_archives(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(odd.key, got)) == sorted(map(odd.key, expected(pages)))


@pytest.mark.parametrize("bad", ["WARC/1.0\r\nno field\r\n\r\n", FAKE.replace("Length: 5", "Length: 4"), FAKE[:-6]])
def test_broken_chain_raises(spark, tmp_path, bad):
    (tmp_path / "a.warc").write_bytes((FAKE + bad).encode())
    with pytest.raises(ValueError, match="chain of records"):
        read_archives(spark, f"file://{tmp_path}/a.warc")


def test_empty_table(spark):
    path = scratch_path(spark, "warc-test")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert page_records(read_archives(spark, path)).count() == 0


def test_query_against_brute_force(spark):
    from cohortcart.llm.queries import op10_warc, table

    sf = "/root/testdata/sf0.001"
    pages = [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf, "pages").collect()]
    out = op10_warc(spark, sf)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(odd.key, out.collect())) == sorted(map(odd.key, expected(pages)))


def test_query_equals_oracle(spark):
    from cohortcart.llm.queries import op10_warc, oracle_sql
    from tests.harness import compare, duck

    sf = "/root/testdata/sf0.001"
    assert compare(op10_warc(spark, sf), oracle_sql()["op10_warc"], duck(sf))["ok"]
