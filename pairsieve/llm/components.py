"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_least(ways: DataFrame) -> DataFrame:
    """Adds the least of each a's neighbours and itself; a node with very many edges is one row per task before the shuffle."""
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return ways.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    return _towards_least(_both_ways(edges)).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    starred = _towards_least(down)
    own = starred.select(F.col("a"), F.col("m").alias("b"))
    others = starred.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).where("a <> b").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; component is the least id reachable.

    Every round links nodes to the least neighbour and is written to the shared
    folder, so a lost executor costs one round. The number of rounds grows with
    the logarithm of the longest chain.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _print(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        now = cut_lineage(_small_star(_large_star(now)))
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
