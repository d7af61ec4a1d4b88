"""Connected components of an undirected edge table, by alternating star contractions.

Each half-step is one partial-minimum aggregation and one equi-join; the number of rounds grows with the logarithm of
the longest path.  No component is ever gathered in one place: a star with very many leaves is a join key with many rows,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.staging import stage


def _stars(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it (large star)."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "at")
    return both.where("v > u").join(least, F.col("u") == F.col("at")).where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges point from the larger node ``a`` to ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
    moved = edges.join(least, F.col("a") == F.col("at"))
    return moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("at", "m")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of ids); the component is its smallest node.

    Self-loops name a node without linking it; nulls name nothing; repeated edges count once.  An empty table gives an
    empty result."""
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null").distinct()
    every = stage(pairs, "edges")
    links = every.where("a != b")
    before = None
    for _ in range(max_rounds):
        links = stage(_small_stars(stage(_stars(links), "large-star")), "small-star")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = every.select(F.col("a").alias("node")).union(every.select("b")).distinct()
    return nodes.join(links.toDF("from", "to"), F.col("node") == F.col("from"), "left").select("node", F.coalesce("to", "node").alias("component"))
