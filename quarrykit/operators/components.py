"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, durable, release

#: Edges up to which Spark may send a round's nodes to all tasks.
FEW = 100_000


def _edges(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _edges(both.join(smallest if few else by_shuffle(smallest), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest if few else by_shuffle(smallest), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _edges(moved.unionByName(smallest.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges (a, b) that is not itself the smallest.

    Every step moves whole edge tables with map-side minima, so a node with very many neighbours is a join key that
    Spark may split, never a group in one task. Lineage is cut in the shared checkpoint folder each round.
    """
    now = durable(_edges(edges))
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        few = mark[0] <= FEW  # a round never adds edges
        before, now = now, durable(_small_star(_large_star(now, few), few))
        release(before)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
