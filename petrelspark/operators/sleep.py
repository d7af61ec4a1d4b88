"""Exploration with sleep sets: every state, and fewer firings.

A state that is reached by firing t sleeps on what its parent had asleep or had fired before t, as far as it is independent of t: those
steps lead, in the other order, to states that a brother reaches anyway.  Breadth first and with states that are known by
their markings, a state may be reached again with other steps asleep.  What it slept on and no longer has to is then fired, with what both
ways let sleep still asleep.  So each transition of a state is fired once at most, no state is lost, and the rounds end when nothing wakes.

Two transitions are independent where they share no place, inhibitor and reset arcs included; so neither can enable, disable or
overfill what the other one needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.functions import markings as M
from petrelspark.operators.explore import WHOLE, StateGraph, _numbered
from petrelspark.operators.statestore import SOUGHT, StateStore, hashed
from petrelspark.plans.net import Net
from petrelspark.staging import counted


def dependents(net: Net) -> DataFrame:
    """(net_id, trans_id, awake): the transitions that share a place with each, itself included."""
    at = net.weights().select("net_id", "place_id", "trans_id").distinct()
    pairs = at.join(at.withColumnRenamed("trans_id", "other"), ["net_id", "place_id"]).select("net_id", "trans_id", "other")
    own = net.transitions.select("net_id", "trans_id", F.col("trans_id").alias("other"))
    return pairs.union(own).groupBy("net_id", "trans_id").agg(F.array_sort(F.collect_set("other")).alias("awake"))


def explore_asleep(net: Net) -> StateGraph:
    """The states of each net as ``explore`` has them, with the edges that were fired; ``enabled`` has all enabled transitions."""
    moves = net.moves().join(dependents(net), ["net_id", "trans_id"]).join(net.initial().select("net_id", "capacity"), "net_id")
    moves = counted(moves, "moves").withColumnRenamed("net_id", "of")
    known_as = hashed(F.col("net_id"), F.col("marking"))
    none = F.array().cast("array<int>")
    after = M.fired(F.col("marking"), F.col("gains"), F.col("resets"))
    start = net.initial().select("net_id", F.lit(0).cast("long").alias("state_id"), F.lit(0).alias("level"), "marking", *known_as, F.lit(1).cast("long").alias("next"))
    start = counted(start, "level")
    store, level = StateStore(net.places.sparkSession), 0
    size = start.count()
    store.add(start, size)
    # what a state sleeps on, by round; the last one holds
    asleep = [counted(start.select("net_id", "state_id", F.lit(0).alias("round"), none.alias("sleep")), "sleep")]
    # a state to open: ``sleep`` stays asleep, and ``only`` is fired, or all that is enabled where it is null
    front = start.select("net_id", "state_id", "marking", "next", none.alias("sleep"), F.lit(None).cast("array<int>").alias("only"))
    fired = []
    while size:
        level += 1
        on = front.join(moves, F.col("net_id") == F.col("of")).where(M.enabled_at(F.col("marking"), F.col("takes"), F.col("stops")))
        on = on.where(F.when(F.col("only").isNull(), ~F.array_contains("sleep", F.col("trans_id"))).otherwise(F.array_contains("only", F.col("trans_id")))).withColumn("to", after).where(M.within(F.col("to"), F.col("capacity")))
        before = F.collect_list("trans_id").over(Window.partitionBy("net_id", "state_id").orderBy("trans_id").rowsBetween(Window.unboundedPreceding, -1))
        step = on.select("net_id", F.col("state_id").alias("src"), "trans_id", F.col("to").alias("marking"), "next", M.asleep_after(M.asleep_with(F.col("sleep"), before), F.col("awake")).alias("asleep"))
        step = counted(step.select("*", *known_as), "step")
        fired.append(step.select("net_id", "src", "trans_id", "h1", "h2"))
        # a marking has as many predecessors as transitions at most, so the lists that meet here are short
        both = F.aggregate(F.slice(F.collect_list("asleep"), 2, 1 << 30), F.element_at(F.collect_list("asleep"), 1), lambda a, b: M.asleep_in_both(a, b))
        met = step.groupBy(*SOUGHT).agg(F.min(F.struct("src", "trans_id")).alias("by"), F.max("next").alias("next"), F.array_sort(both).alias("arrived"))
        known = store.near(step)
        last = reduce(DataFrame.union, asleep).groupBy("net_id", "state_id").agg(F.max_by("sleep", "round").alias("slept"))
        met = counted(met.join(known, SOUGHT, "left").join(last, ["net_id", "state_id"], "left"), "met")
        new, found, _ = _numbered(met.where("state_id is null").select(*SOUGHT, "by", "next"), level, None, size <= WHOLE)
        store.add(new, found)
        opened = new.join(met.where("state_id is null").select(*SOUGHT, "arrived"), SOUGHT).select("net_id", "state_id", "marking", F.col("next"), F.col("arrived").alias("sleep"), F.lit(None).cast("array<int>").alias("only"))
        again = met.where("state_id is not null").select("net_id", "state_id", "marking", "next", M.asleep_in_both(F.col("slept"), F.col("arrived")).alias("sleep"), F.array_except("slept", "arrived").alias("only")).where("size(only) > 0")
        # numbers go on from the most that a net has; a net without new states keeps its own
        front = counted(opened.unionByName(again).withColumn("next", F.max("next").over(Window.partitionBy("net_id"))), "front")
        asleep.append(front.select("net_id", "state_id", F.lit(level).alias("round"), "sleep"))
        if level % 8 == 0:
            asleep = [counted(reduce(DataFrame.union, asleep).groupBy("net_id", "state_id").agg(F.max("round").alias("round"), F.max_by("sleep", "round").alias("sleep")), "sleep")]
        size = front.count()
    known = counted(store.every(), "known")
    on = known.select("net_id", "h1", "h2", F.col("state_id").alias("dst"))
    edges = known.where("false").select("net_id", F.col("state_id").alias("src"), F.lit(0).alias("trans_id"), F.col("state_id").alias("dst"))
    if fired:
        edges = counted(reduce(DataFrame.union, fired).join(on, ["h1", "h2", "net_id"]).select("net_id", "src", "trans_id", "dst"), "edges")
    may = known.join(moves, F.col("net_id") == F.col("of")).where(M.enabled_at(F.col("marking"), F.col("takes"), F.col("stops")))
    enabled = may.groupBy("net_id", "state_id").agg(F.array_sort(F.collect_set("trans_id")).alias("enabled"))
    states = counted(known.join(enabled, ["net_id", "state_id"], "left").select("net_id", "state_id", "level", "marking", F.coalesce("enabled", none).alias("enabled")), "states")
    failures = may.where(~M.within(after, F.col("capacity"))).select("net_id", F.col("state_id").alias("src"), "trans_id", F.lit("capacity").alias("reason"))
    return StateGraph(net, states, edges, failures, states.where("false").select("net_id"), False)
