"""Coverability with dominance: a marking that another one covers is not looked into.

A null element of a marking is ω.  Nodes know their parent, not their ancestors: a new marking that strictly covers some node of its net
walks up its own line and is pumped where it strictly covers one that it descends from.  A new marking that a node found before,
or another new one, covers is dropped with all that would come of it, since what it can do the larger one can.  Only markings whose supports
nest are compared: supports (the sets of marked places) are few, meet first, and bring their markings along.
Capacities are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.functions import markings as M
from petrelspark.plans.net import Net
from petrelspark.staging import counted


def _support(marking: Column) -> Column:
    """The positions of marked places; ω is marked."""
    return F.filter(F.transform(marking, lambda m, i: F.when(m.isNull() | (m > 0), i)), lambda i: i.isNotNull())


def covering(small: DataFrame, large: DataFrame, strict: bool) -> DataFrame:
    """Pairs (net_id, a, b) of ids: the marking of ``small`` (net_id, a, marking) and the one of ``large`` (net_id, b, marking) that covers it."""
    s, l = small.withColumn("inner", _support(F.col("marking"))), large.withColumn("outer", _support(F.col("marking")))
    si, lo = s.select("net_id", "inner").distinct(), l.select("net_id", "outer").distinct()
    nested = si.join(lo, "net_id").where(F.size(F.array_except("inner", "outer")) == 0)
    both = nested.join(s.withColumnRenamed("marking", "low"), ["net_id", "inner"]).join(l.withColumnRenamed("marking", "high"), ["net_id", "outer"])
    over = (M.strictly_covers if strict else M.covers)(F.col("high"), F.col("low"))
    return both.where(over).select("net_id", "a", "b")


def minimal_coverability(net: Net, limit: int = 10_000) -> DataFrame:
    """(net_id, node, parent, trans_id, depth, marking, maximal, cut): the nodes that were looked into; the maximal ones are the minimal coverability set, unless the net
    has more than ``limit`` nodes (``cut``)."""
    moves = counted(net.moves(), "moves").withColumnRenamed("net_id", "of")
    none = F.lit(None)
    start = net.initial().select("net_id", F.lit(0).cast("long").alias("node"), none.cast("long").alias("parent"), none.cast("int").alias("trans_id"), F.lit(0).alias("depth"), "marking", F.lit(1).cast("long").alias("next"))
    front = nodes = counted(start, "nodes")
    over, depth = front.where("false").select("net_id"), 0
    left = F.transform("marking", lambda m, i: m + F.coalesce(F.try_element_at("gains", i), F.lit(0).cast("long")))
    empty = F.transform(left, lambda m, i: F.when(F.array_contains(F.coalesce("resets", F.array().cast("array<int>")), i), F.lit(0).cast("long")).otherwise(m))
    enabled = F.forall(F.coalesce("takes", F.array()), lambda a: F.coalesce(F.element_at(F.col("marking"), a["pos"] + 1) >= a["weight"], F.lit(True)))
    while not front.isEmpty():
        depth += 1
        step = front.drop("parent", "trans_id").join(moves, F.col("net_id") == F.col("of")).where(enabled).select("net_id", F.col("node").alias("parent"), "trans_id", empty.alias("marking"), "next")
        key = F.struct("parent", "trans_id")
        made = counted(step.groupBy("net_id", "marking").agg(F.min(key).alias("by"), F.max("next").alias("next")).withColumn("c", F.xxhash64("net_id", "by")), "made")
        # only what strictly covers some node can strictly cover an ancestor
        may = covering(nodes.select("net_id", F.col("node").alias("a"), "marking"), made.select("net_id", F.col("c").alias("b"), "marking"), True).select("net_id", F.col("b").alias("c")).distinct()
        walk = counted(made.join(may, ["net_id", "c"], "left_semi").select("net_id", "c", "marking", F.col("by.parent").alias("at")), "walk")
        pumped = None
        above = nodes.select("net_id", F.col("node").alias("at"), F.col("parent").alias("up"), F.col("marking").alias("m0"))
        while not walk.isEmpty():
            seen = walk.join(above, ["net_id", "at"])
            walk = counted(seen.select("net_id", "c", F.when(M.strictly_covers(F.col("marking"), F.col("m0")), M.accelerated(F.col("marking"), F.col("m0"))).otherwise(F.col("marking")).alias("marking"), F.col("up").alias("at")), "walk")
            ended = walk.where("at is null").select("net_id", "c", F.col("marking").alias("grown"))
            pumped = ended if pumped is None else pumped.union(ended)
            walk = walk.where("at is not null")
        if pumped is not None:
            made = made.join(pumped, ["net_id", "c"], "left").withColumn("marking", F.coalesce("grown", "marking")).drop("grown")
            made = counted(made.groupBy("net_id", "marking").agg(F.min("by").alias("by"), F.max("next").alias("next")).withColumn("c", F.xxhash64("net_id", "by")), "made")
        named = made.select("net_id", F.col("c").alias("a"), "marking")
        old = covering(named, nodes.select("net_id", F.col("node").alias("b"), "marking"), False).select("net_id", F.col("a").alias("c"))
        among = covering(named, made.select("net_id", F.col("c").alias("b"), "marking"), True).select("net_id", F.col("a").alias("c"))
        kept = made.join(old.union(among).distinct(), ["net_id", "c"], "left_anti")
        number = "row_number() over (partition by net_id order by by) - 1"
        kept = counted(kept.selectExpr("net_id", f"next + {number} as node", "by.parent as parent", "by.trans_id as trans_id", f"{depth} as depth", "marking", "next + count(*) over (partition by net_id) as next"), "nodes")
        nodes = nodes.unionByName(kept)
        full = counted(nodes.groupBy("net_id").count().where(F.col("count") > limit).select("net_id"), "full")
        over = over.union(full)
        front = kept.join(full, "net_id", "left_anti")
        if depth % 8 == 0:
            nodes = counted(nodes, "nodes")
    nodes = counted(nodes, "nodes")
    beaten = covering(nodes.select("net_id", F.col("node").alias("a"), "marking"), nodes.select("net_id", F.col("node").alias("b"), "marking"), True).select("net_id", F.col("a").alias("node")).distinct().withColumn("beaten", F.lit(True))
    cut = over.distinct().withColumn("cut", F.lit(True))
    out = nodes.join(beaten, ["net_id", "node"], "left").join(cut, "net_id", "left")
    return out.select("net_id", "node", "parent", "trans_id", "depth", "marking", F.col("beaten").isNull().alias("maximal"), F.coalesce("cut", F.lit(False)).alias("cut"))


def bounds(net: Net, limit: int = 10_000) -> DataFrame:
    """(net_id, place_id, verdict, bound) from the maximal markings alone: Bounded with the most tokens, Unbounded, or Unknown beyond the limit."""
    top = minimal_coverability(net, limit).where("maximal")
    ids = net.places.groupBy("net_id").agg(F.array_sort(F.collect_list("place_id")).alias("ids"))
    at = top.join(ids, "net_id").select("net_id", "cut", "ids", F.posexplode("marking").alias("pos", "n")).withColumn("place_id", F.element_at("ids", F.col("pos") + 1))
    each = at.groupBy("net_id", "place_id").agg(F.max("n").alias("most"), F.max(F.col("n").isNull()).alias("open"), F.max("cut").alias("cut"))
    verdict = F.when(F.col("open"), "Unbounded").when(F.col("cut"), "Unknown").otherwise("Bounded")
    return each.select("net_id", "place_id", verdict.alias("verdict"), F.when(verdict == "Bounded", F.col("most")).alias("bound"))
