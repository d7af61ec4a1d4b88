"""Closures over edge tables: each round joins only what the last one found with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.staging import settle


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None, max_rounds: int = 10_000, partial: bool = False) -> DataFrame:
    """(root, node, depth): the nodes that edges (src, dst) lead to, from each root (root, node), itself included at depth 0.

    With ``partial`` those within ``max_rounds`` steps; else a closure that needs more is an error.

    ``keys``: further columns that edges and roots share and that edges never cross."""
    keys = keys or []
    e = edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct()
    front = found = settle(roots.select(*keys, "root", "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_rounds + 1):
        step = front.join(e.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, "root", F.col("dst").alias("node")).distinct()
        front = settle(step.join(found, [*keys, "root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        found = found.union(front)
    if partial:
        return found
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def call_edges_aggregated(calls: DataFrame) -> DataFrame:
    """One edge for each (caller, callee), with its sites in order."""
    return calls.groupBy("caller", "callee").agg(F.array_sort(F.collect_list(F.struct("site_kind", "location"))).alias("sites"), F.count("*").alias("n_sites"))


def spawn_map(calls: DataFrame) -> DataFrame:
    """(caller, dest_local, callees): what each handle's spawn may run."""
    return calls.where("site_kind in ('spawn', 'scope_spawn', 'async_spawn')").groupBy("caller", "dest_local").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def concurrent_roots(users: DataFrame, *others: DataFrame) -> DataFrame:
    """The union of functions that use locks, condition variables, atomics or channels."""
    out = users.select("func")
    for o in others:
        out = out.union(o.select("func"))
    return out.distinct()


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_length: int = 20) -> DataFrame:
    """(path): the paths without a repeated node from a source (node) to a target (node), of at most ``max_length`` edges."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    goal = targets.select(F.col("node").alias("goal")).distinct()
    front = settle(sources.select("node").distinct().select(F.array("node").alias("path"), "node"))
    out = front.join(goal, F.col("node") == F.col("goal"), "left_semi").select("path")
    for _ in range(max_length):
        front = settle(front.join(e, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        if front.isEmpty():
            break
        out = out.union(front.join(goal, F.col("node") == F.col("goal"), "left_semi").select("path"))
    return out
