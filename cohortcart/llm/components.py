"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortcart.session import stored


SALTS = 64


def _salted(edges: DataFrame) -> DataFrame:
    """The rows of one centre ``u`` are dealt over ``SALTS`` keys ``(u, s)``, so that no task gets a large centre whole."""
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _least(salted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smallest neighbour ``m`` per centre ``u``, and the same for each of the centre's keys ``(u, s)``, of which
    it has at most ``SALTS``."""
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.min("m").alias("m"))
    return whole, parts.select("u", "s").join(whole, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = _salted(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    _, least = _least(both)
    return both.where("v > u").join(least, ["u", "s"]).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = _salted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    whole, least = _least(down)
    return (down.join(least, ["u", "s"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(whole.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u long, v long)``; the root is the smallest
    node of its component.  Each round is stored in the shared checkpoint folder, and the rounds
    end when the edges no longer change, after about the logarithm of the longest chain; only
    checksums reach the driver."""
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        edges = stored(_small_star(_large_star(edges)), "edges")
