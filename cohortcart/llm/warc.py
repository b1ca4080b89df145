"""WARC: pages written as archive records, and archives read back with boundary verification.

Writing.  One record per page.  Of pages with equal payloads the one with the smallest id is a
``response`` that carries the payload; the others are ``revisit`` records that refer to it.
Spark's text writer puts records into as many files as there are partitions.

Reading.  Archives are split anywhere, so a task sees the record magic without knowing whether it
starts a record or lies inside a payload.  Every task therefore emits, for each magic that is
followed by a sound header, a candidate: its offset and its successor's offset.  Block sizes
summed per file make the offsets absolute.  Chains are first followed inside each block, which
leaves one exit per candidate; pointer jumping over the blocks, from the start of each file, then
tells where the true chain enters every block.  Records on the chain are kept; magic inside
payloads is not reachable and is given back to the record that contains it.

Payload digests are computed from the bytes read.  Only offsets, headers and digests are stored
and shuffled; bytes travel a second time only for records whose payload contains the magic.

Defined cases: null html is an empty payload; equal payloads (empty ones too) share one response;
rows that repeat the smallest id of a payload are responses each; a null ``page_id`` refers to the
smallest id, or is a response where its payload has no id at all; line breaks in a url are
percent-encoded; a null url is empty; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortcart.session import stored

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


# -- writing ------------------------------------------------------------------------------------

def _digest(payload: Column) -> Column:
    """Base32 SHA-1: every 5 hex digits are 4 digits to the base 32, written in other letters."""
    digits = F.sha1(payload.cast("binary"))
    fours = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: str, url: Column, refers_to: Column | None) -> Column:
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    body_length = F.octet_length(F.lit(HTTP_HEAD)) + (F.octet_length("payload") if kind == "response" else 0)
    parts = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), name(F.col("page_id")),
             F.lit("\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
             F.col("digest")]
    if refers_to is not None:
        parts += [F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(refers_to)]
    parts += [F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
              body_length.cast("string"), F.lit("\r\n\r\n" + HTTP_HEAD)]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (``page_id, url, html``) as archive files under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
                        .alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", _digest(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    # stored, so that Spark knows how many payloads are shared: few are broadcast and no html moves,
    # many are joined by sorting
    shared = stored(rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("digest", "size", "first"), "shared")
    marked = rows.join(shared, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.col("url")
    record = F.when(revisit, F.concat(_header("revisit", url, F.col("first")), F.lit("\r\n\r"))).otherwise(
        F.concat(_header("response", url, None), F.col("payload"), F.lit("\r\n\r")))
    # the line separator completes each record's closing line breaks
    marked.select(record.alias("value")).write.option("lineSep", "\n").text(path)


# -- reading: candidates ------------------------------------------------------------------------

_NAME = re.compile(rb"[A-Za-z-]+")
PIECES = "file string, block long, row long, start long, size long, length long, next long, leaves long, " \
         "kind string, id string, refers string, claimed string, payload_bytes long, digest string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic: one row per piece, with its file and block."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _head(piece: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Header length, content length and fields, where the piece starts like a record; a header may be
    of any length."""
    stop = piece.find(END)
    if stop < 0:
        return None
    fields = {}
    for line in piece[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name) or b"\n" in value:
            return None
        fields[name.lower()] = value.strip(b" \t")
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return stop + 4, int(length), fields


def _payload(content: bytes) -> bytes:
    at = content.find(END)
    return content[at + 4:] if at >= 0 else content


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _follow(start: np.ndarray, nxt: np.ndarray, end: int) -> np.ndarray:
    """For each candidate the first successor at or past the block's end; -1 where the chain breaks."""
    place = {int(s): i for i, s in enumerate(start)}
    leaves = np.full(len(start), -1, dtype=np.int64)
    for i in range(len(start) - 1, -1, -1):
        if nxt[i] >= end:
            leaves[i] = nxt[i]
        elif nxt[i] >= 0 and int(nxt[i]) in place:
            leaves[i] = leaves[place[int(nxt[i])]]
    return leaves


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece: offsets from the block's first piece, the successor a sound header claims,
    where its chain leaves the block, and the payload's digest if the piece is the whole record."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string())
                        for n, t in (f.split() for f in PIECES.split(", "))])

    def closed(key, rows) -> pa.RecordBatch:
        start = np.array([r["start"] for r in rows], dtype=np.int64)
        nxt = np.array([r["next"] for r in rows], dtype=np.int64)
        end = rows[-1]["start"] + rows[-1]["size"] + len(MAGIC)
        for r, leaves in zip(rows, _follow(start, nxt, end), strict=True):
            r["leaves"] = int(leaves)
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=schema)

    key, rows, at = None, [], 0
    for batch in batches:
        files, blocks, values = batch.column(0), batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            now = (files[i].as_py(), blocks[i].as_py())
            if now != key:
                if rows:
                    yield closed(key, rows)
                key, rows, at = now, [], 0
            piece = values[i].as_py()
            row = {"file": key[0], "block": key[1], "row": len(rows), "start": at, "size": len(piece),
                   "length": -1, "next": -1}
            if head := _head(piece):
                before, content, fields = head
                row |= {"length": before + content, "next": at + before + content + 4 + len(MAGIC),
                        "kind": _text(fields[b"warc-type"]), "id": _text(fields.get(b"warc-record-id")),
                        "refers": _text(fields.get(b"warc-refers-to")),
                        "claimed": _text(fields.get(b"warc-payload-digest"))}
                if len(piece) >= before + content:
                    payload = _payload(piece[before:before + content])
                    row |= {"payload_bytes": len(payload), "digest": base32_sha1(payload)}
            rows.append(row)
            at += len(piece) + len(MAGIC)
    if rows:
        yield closed(key, rows)


# -- reading: verification ----------------------------------------------------------------------

def _entries(pieces: DataFrame) -> DataFrame:
    """``file, at``: the offsets at which each file's true chain enters its blocks.

    Pointer jumping: every round follows links twice as long, so the rounds are the logarithm of
    the number of blocks of the largest file."""
    ends = pieces.where("leaves >= 0").select("file", F.col("at").alias("here"), F.col("exit").alias("there"))
    first = pieces.groupBy("file").agg(F.min("at").alias("at")).select("file", (F.col("at") + len(MAGIC)).alias("at"))
    possible = ends.select("file", F.col("there").alias("here")).unionByName(
        first.select("file", F.col("at").alias("here"))).distinct()
    links = stored(ends.join(possible, ["file", "here"], "left_semi"), "links")
    reached, before = stored(first, "entries"), -1
    while (count := reached.count()) != before:
        before = count
        step = reached.join(links, [reached["file"] == links["file"], reached["at"] == links["here"]]).select(
            reached["file"], F.col("there").alias("at"))
        reached = stored(reached.unionByName(step).distinct(), "entries")
        far = links.select(F.col("file").alias("f"), F.col("here").alias("middle"), F.col("there").alias("far"))
        links = stored(links.join(far, (F.col("file") == F.col("f")) & (F.col("there") == F.col("middle")), "left")
                       .select("file", "here", F.coalesce("far", "there").alias("there")), "links")
    return reached


def _on_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: marks the pieces that start a record of the true chain."""
    rows = rows.sort_values("at").reset_index(drop=True)
    place = {a: i for i, a in enumerate(rows["at"])}
    follow = (rows["at"] + rows["next"] - rows["start"]).where(rows["next"] >= 0, -1).tolist()
    real = np.zeros(len(rows), dtype=bool)
    for i in np.flatnonzero(rows["entry"]):
        while not real[i] and rows["next"].iat[i] >= 0:
            real[i] = True
            i = place.get(follow[i], -1)
            if i < 0:
                break
    return pd.DataFrame({"file": rows["file"], "at": rows["at"], "real": real})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: ``file, at, kind, id, refers, claimed, payload_bytes, digest``; ``at`` is the
    offset behind the record's magic.  Raises where the records of a file do not lead to its end."""
    found = stored(_pieces(spark, path).mapInArrow(_candidates, PIECES), "pieces")
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    order = Window.partitionBy("file").orderBy("block")
    bases = blocks.select("file", "block", (F.sum("bytes").over(order) - F.col("bytes")).alias("base"))
    placed = found.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("start")).withColumn(
        "exit", F.col("base") + F.col("leaves"))
    placed = stored(placed, "placed")
    reached = _entries(placed)
    # a whole chain's last record leads to the end of its file
    broken = blocks.groupBy("file").agg(F.sum("bytes").alias("at")).join(reached, ["file", "at"], "left_anti").first()
    if broken:
        raise ValueError(f"{broken['file']}: the chain of records ends before the file does")
    entries = reached.select("file", "at", F.lit(True).alias("entry"))
    marked = placed.join(entries, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    chain = marked.select("file", "block", "at", "start", "next", "entry").groupBy("file", "block").applyInPandas(
        _on_chain, "file string, at long, real boolean")
    known = stored(placed.join(chain, ["file", "at"]), "known")
    records = known.where("real and payload_bytes is not null")
    split = known.where("real and payload_bytes is null")
    columns = ["file", "at", "kind", "id", "refers", "claimed", "payload_bytes", "digest"]
    if split.isEmpty():
        return records.select(*columns)
    return records.select(*columns).unionByName(_rejoined(spark, path, known).select(*columns))


def _rejoined(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Records whose payload contains the magic, put together from their pieces.

    The pieces wanted are few or many; Spark sees their number and picks the join."""
    # the record a piece lies in: the last one begun in its block, else in a block before it
    begun = F.when(F.col("real"), F.struct("at", "length", "payload_bytes"))
    inside = F.last(begun, ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("at"))
    lasts = known.groupBy("file", "block").agg(F.max(begun).alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    owned = known.withColumn("i", inside).join(carried, ["file", "block"])
    wanted = (owned.withColumn("o", F.coalesce("i", "carried")).where("o is not null and o.payload_bytes is null and at <= o.at + o.length")
              .select("file", "block", "row", "at", F.col("o.at").alias("owner")))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, 0
        for batch in batches:
            rows = []
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = row + 1 if (file, block) == key else 0
                key = (file, block)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, type=pa.int64()),
                                              batch.column(2)], names=["file", "block", "row", "value"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, at, parts in zip(*[batch.column(k) for k in range(3)], strict=True):
                whole = MAGIC.join(p["value"] for p in parts.as_py())
                before_, content, _ = _head(whole)
                payload = _payload(whole[before_:before_ + content])
                out.append((file.as_py(), at.as_py(), len(payload), base32_sha1(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out]) for k in range(4)],
                                             names=["file", "at", "payload_bytes", "digest"])

    pieces = _pieces(spark, path).mapInArrow(numbered, "file string, block long, row long, value binary")
    lists = pieces.join(wanted, ["file", "block", "row"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = lists.mapInArrow(joined, "file string, at long, payload_bytes long, digest string")
    return known.where("real and payload_bytes is null").drop("payload_bytes", "digest").join(whole, ["file", "at"])


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records that
    ``write_archives`` made; a revisit takes size and digest from the response it refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = records.select(as_long(F.col("id")).alias("page_id"), F.col("payload_bytes"), "digest", "kind",
                          as_long(F.col("refers")).alias("refers_to"),
                          F.regexp_replace("claimed", "^sha1:", "").alias("claimed"))
    responses = rows.where("kind = 'response'")
    firsts = responses.groupBy(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest")).agg(
        F.first("payload_bytes").alias("r_bytes"))
    revisits = rows.where("kind = 'revisit'").join(
        firsts, (F.col("refers_to") == F.col("r_id")) & (F.col("claimed") == F.col("r_digest")), "left")
    return responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"),
                            F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"),
                        F.col("kind").alias("record_type"), "refers_to"))


def oracle() -> str:
    """What ``page_records`` gives for archived ``pages``, in DuckDB SQL."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) % 32 AS INTEGER) + 1, 1)"
    letters = " || ".join(letter.format(shift) for shift in (15, 10, 5, 0))
    fives = "list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(h), CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT))"
    again = "first IS NOT NULL AND page_id IS DISTINCT FROM first"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform({fives}, lambda v: {letters}), '') AS payload_digest,
       CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN {again} THEN first END AS refers_to
FROM d"""
