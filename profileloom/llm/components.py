"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import cut, hot_hashes, salted_join

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest node near it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = salted_join(both, least, ["a"], hot_hashes(both, ["a"]), ["b"])
    return joined.where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = salted_join(edges, least, ["b"], hot_hashes(edges, ["b"]), ["a"])
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (two columns of one orderable type); root is the least node of the component.

    Self-links and repeated links have no effect, rows with a null end are ignored, no links give no rows. Each round
    is a few grouped aggregates and joins, in which hubs are salted; the rounds grow with the logarithm of the diameter.
    """
    x, y = edges.columns[:2]
    edges = edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).distinct()
    edges = cut(edges)
    before = _digest(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        edges = cut(_small_star(cut(_large_star(edges))))
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
