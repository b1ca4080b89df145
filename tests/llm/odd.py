"""Awkward documents for every text operator, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

SCHEMA = (StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType())
          .add("source", StringType()).add("n_chars", LongType()))
# names that the operators use inside
CLASHING = ["size", "shard", "slot", "score", "kept", "rules", "part", "ids", "bucket", "fp", "rate_scale", "full",
            "cut", "copies", "record", "place", "doc", "unit", "line", "root"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randint(0, vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(n)]
    return " ".join(words).replace(". ", ".\n", 1)


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(3, 220)), "en", f"s{i % 4}", 1) for i in range(60)]
    out += [
        (100, None, "en", "s0", None), (101, "", None, "s1", 0), (102, " \t\n\r\x0b\x0c ", "en", None, 7),
        (103, "one", "en", None, 3), (104, "two words", "en", "s0", 9), (105, "Ünï ÇODE 你好 İstanbul ΣΑΣ ﬁ x²", "xx", "é", 1),
        (None, "a text without an id " * 30, "en", "s2", 1), (None, None, None, None, None),
        (106, prose(rng, 60_000, 5000), "en", "s3", 1),            # very long
        (107, "word " * 4000, "en", "s3", 1),                       # one word again and again
        (108, "x" * 50_000, "en", "s1", 1),                         # one very long word
        (109, "the cat sat on the mat\n" * 40, "en", "s2", 1),
        (110, "control \x1c\x1f chars \x85 and \xa0 blanks", "en", "s2", 1),
        (111, "<|endoftext|> it's DON'T we'll <|startoftext|>", "en", "s2", 1),
    ]
    out += [out[7]] * 3                                             # repeated rows
    out += [(200 + i, out[9][1], "en", "hot", 1) for i in range(30)]  # copies
    return out


def documents(spark: SparkSession, clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    if clash:
        for name in CLASHING:
            df = df.selectExpr("*", f"concat('v', doc_id) AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    schema = StructType().add("doc_id", LongType()).add("quality", IntegerType()).add("toxic", IntegerType())
    rows_ = [(i, 0 if i % 9 == 0 else 1, 0) for i in range(60)] + [(109, 0, 0), (107, 0, 0), (3, None, 0), (None, 1, 0),
                                                                    (4, 1, None), (5, 1, 0), (5, 1, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows_, schema)


def key(row) -> tuple:
    return tuple("" if v is None else str(v) for v in row)
