"""Strongly connected components of any number of graphs, by trimming and colours.

What has no edge in or none out among what is left is a component of its own and goes.  The others take the greatest node that
leads to them as their colour; a node of its own colour is a root, and the nodes of that colour that lead to it are its component.
Components go, and so on.  Each round propagates only what the last one changed, so its cost follows the changes, and no
component is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.operators.explore import StateGraph
from petrelspark.staging import counted


def _spread(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels (keys, node, label) with the greatest label that leads to each node over edges (keys, src, dst)."""
    front = labels
    step = 0
    while True:
        step += 1
        sent = front.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.max("label").alias("sent"))
        front = counted(sent.join(labels, [*keys, "node"]).where("sent > label").select(*keys, "node", F.col("sent").alias("label")), "spread")
        if front.isEmpty():
            return labels
        labels = labels.unionByName(front).groupBy(*keys, "node").agg(F.max("label").alias("label"))
        labels = counted(labels, "labels")


def strong_components(edges: DataFrame, keys: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(keys, node, component): the least node of each node's component.  ``edges``: (keys, src, dst); ``keys``: columns that tell graphs apart;
    ``nodes``: (keys, node) to be named besides the ends of edges.  Rows with a null end are left out, repeated ones count once."""
    keys = keys or []
    left = counted(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    ends = left.select(*keys, F.col("src").alias("node")).union(left.select(*keys, "dst"))
    every = counted((ends if nodes is None else ends.union(nodes.select(*keys, "node"))).distinct(), "nodes")
    left = counted(left.where("src != dst"), "edges")
    done: list[DataFrame] = []
    while not left.isEmpty():
        inner = left.select(*keys, F.col("src").alias("node")).intersect(left.select(*keys, F.col("dst").alias("node")))
        kept = counted(left.join(inner.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(inner.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi"), "edges")
        if kept.count() < left.count():  # trimming may go on
            left = kept
            continue
        names = left.select(*keys, F.col("src").alias("node")).distinct()
        colours = _spread(left, counted(names.select(*keys, "node", F.col("node").alias("label")), "labels"), keys)
        of = lambda c: colours.select(*keys, F.col("node").alias(c), F.col("label").alias(f"{c}_colour"))
        within = counted(left.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst"]), "coloured")
        # backwards from the roots, within one colour
        back = within.where("src_colour = dst_colour").select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src_colour").alias("colour"))
        front = found = counted(colours.where("node = label").select(*keys, "node", F.col("label").alias("root")), "roots")
        while not front.isEmpty():
            step = front.join(back.withColumnRenamed("src", "node"), [*keys, "node"]).where("colour = root").select(*keys, F.col("dst").alias("node"), "root").distinct()
            front = counted(step.join(found, [*keys, "node"], "left_anti"), "back")
            found = found.unionByName(front)
        found = counted(found, "found")
        done.append(found)
        gone = found.select(*keys, "node")
        left = counted(left.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti"), "edges")
    if not done:
        return every.select(*keys, "node", F.col("node").alias("component"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    least = found.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    named = found.join(least, [*keys, "root"]).select(*keys, "node", "component")
    return every.join(named, [*keys, "node"], "left").select(*keys, "node", F.coalesce("component", "node").alias("component"))


def cycles(graph: StateGraph) -> DataFrame:
    """(net_id, component, states, closed, blocked): the components of a state graph that have a cycle; ``component`` is the least state, ``closed`` if no edge
    leaves it, ``blocked`` the locks that no state of it can take."""
    edges = graph.edges.select("net_id", "src", "dst").distinct()
    of = counted(strong_components(edges, ["net_id"]), "components")
    on = lambda c: of.select("net_id", F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    ways = edges.join(on("src"), ["net_id", "src"]).join(on("dst"), ["net_id", "dst"])
    turns = ways.groupBy("net_id", F.col("src_component").alias("component")).agg(F.count_if(F.col("src_component") == F.col("dst_component")).alias("inside"), F.count_if(F.col("src_component") != F.col("dst_component")).alias("outside")).where("inside > 0")
    members = of.select("net_id", F.col("node").alias("state_id"), "component").join(turns, ["net_id", "component"])
    locks = graph.net.transitions.where("ttype in ('Lock', 'RwLockRead', 'RwLockWrite')").select("net_id", "trans_id", F.col("res_place").alias("lock"))
    every = locks.groupBy("net_id").agg(F.array_sort(F.collect_set("lock")).alias("every"))
    taken = members.join(graph.states.select("net_id", "state_id", F.explode_outer("enabled").alias("trans_id")), ["net_id", "state_id"]).join(locks, ["net_id", "trans_id"], "left")
    sums = taken.groupBy("net_id", "component").agg(F.countDistinct("state_id").alias("states"), F.collect_set("lock").alias("can"), F.max("outside").alias("outside"))
    blocked = F.coalesce(F.array_except("every", "can"), F.array().cast("array<int>"))
    return sums.join(every, "net_id", "left").select("net_id", "component", "states", (F.col("outside") == 0).alias("closed"), blocked.alias("blocked"))
