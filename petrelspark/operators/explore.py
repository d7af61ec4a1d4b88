"""Reachable markings, breadth first, of any number of nets in one loop.

One step of the loop fires every enabled transition of the frontier (a join on ``net_id`` and array expressions), drops
markings that are known (a lookup by hash, see ``statestore``), and numbers the new ones by discovery: by the least (parent,
transition) that leads to them, in blocks of parents, so that no task orders a net's whole frontier.  Each step is written to the shared
folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from petrelspark.functions import markings as M
from petrelspark.operators.statestore import SOUGHT, StateStore, hashed
from petrelspark.plans.net import Net
from petrelspark.staging import counted, settle


@dataclass(frozen=True)
class StateGraph:
    """states(net_id, state_id, level, marking, enabled), edges(net_id, src, trans_id, dst), failures(net_id, src, trans_id, reason), stats.

    ``every_edge``: false where some firings were left out on purpose, so that a state without an edge need not be stuck."""

    net: Net
    states: DataFrame
    edges: DataFrame
    failures: DataFrame
    truncated: DataFrame
    every_edge: bool = True

    def terminal(self) -> DataFrame:
        """States in which no transition is enabled."""
        return self.states.where(F.size("enabled") == 0)

    def moving(self) -> DataFrame:
        """(net_id, state_id) of the states that some firing leaves."""
        if self.every_edge:
            return self.edges.select("net_id", F.col("src").alias("state_id")).distinct()
        on = self.states.select("net_id", "state_id", F.explode("enabled").alias("trans_id"))
        return on.join(self.failures.select("net_id", F.col("src").alias("state_id"), "trans_id"), ["net_id", "state_id", "trans_id"], "left_anti").select("net_id", "state_id").distinct()

    def stats(self) -> DataFrame:
        """net_id, states, edges, deadlocks (terminal states), truncated."""
        s = self.states.groupBy("net_id").agg(F.count("*").alias("states"), F.count_if(F.size("enabled") == 0).alias("deadlocks"))
        e = self.edges.groupBy("net_id").agg(F.count("*").alias("edges"))
        t = self.truncated.groupBy("net_id").agg(F.lit(True).alias("cut"))
        return s.join(e, "net_id", "left").join(t, "net_id", "left").select("net_id", "states", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), "deadlocks", F.coalesce("cut", F.lit(False)).alias("truncated"))

    def snapshots(self) -> DataFrame:
        """The places of each state with tokens: name, type, span, tokens, capacity."""
        at = self.states.select("net_id", "state_id", F.posexplode("marking").alias("pos", "n")).where("n > 0")
        places = self.net.places.withColumn("pos", F.row_number().over(Window.partitionBy("net_id").orderBy("place_id")) - 1)
        return at.join(places, ["net_id", "pos"]).select("net_id", "state_id", "place_id", "name", "place_type", "span", F.col("n").alias("tokens"), "capacity")

    def changes(self) -> DataFrame:
        """For each edge the places whose tokens it changes."""
        a = self.states.select("net_id", F.col("state_id").alias("src"), F.col("marking").alias("before"))
        b = self.states.select("net_id", F.col("state_id").alias("dst"), F.col("marking").alias("after"))
        return self.edges.join(a, ["net_id", "src"]).join(b, ["net_id", "dst"]).select("net_id", "src", "trans_id", "dst", F.inline(M.changes(F.col("before"), F.col("after"))))

    def paths(self) -> DataFrame:
        """(net_id, state_id, path): the transitions that first led to each state."""
        parents = self.edges.where("src < dst").groupBy("net_id", F.col("dst").alias("state_id")).agg(F.min(F.struct("src", "trans_id")).alias("by"))
        found = self.states.where("state_id = 0").select("net_id", "state_id", F.array().cast("array<int>").alias("path"))
        out = front = settle(found)
        while not front.isEmpty():
            front = settle(parents.select("net_id", F.col("state_id").alias("to"), "by").join(front, (F.col("by.src") == F.col("state_id")) & (parents["net_id"] == front["net_id"])).select(parents["net_id"], F.col("to").alias("state_id"), F.concat("path", F.array("by.trans_id")).alias("path")))
            out = out.union(front)
        return out


#: Parents whose new states are numbered together, where a frontier is larger than ``WHOLE``.
BLOCK, WHOLE = 4096, 500_000


def _numbered(fresh: DataFrame, level: int, limit: int | None, whole: bool) -> tuple[DataFrame, int, int]:
    """New states (net_id, marking, h1, h2, by, next) with their numbers, which go on from ``next``; how many there are, and how many of them are refused.

    ``whole``: the frontier is so small that a task may order all of a net's part."""
    if whole:
        of = Window.partitionBy("net_id")
        ranked = fresh.withColumns({"rank": F.row_number().over(of.orderBy("by")) - 1, "found": F.count(F.lit(1)).over(of), "before": F.lit(0)})
    else:
        f = fresh.withColumn("block", F.floor(F.col("by.src") / BLOCK))
        sums = f.groupBy("net_id", "block").count()
        before = sums.selectExpr("net_id as of", "block as of_block", "sum(count) over (partition by net_id order by block) - count as before", "sum(count) over (partition by net_id) as found")
        ranked = f.withColumn("rank", F.row_number().over(Window.partitionBy("net_id", "block").orderBy("by")) - 1)
        ranked = ranked.join(before, (F.col("net_id") == F.col("of")) & (F.col("block") == F.col("of_block")))
    rows = ranked.select("net_id", (F.col("next") + F.col("before") + F.col("rank")).alias("state_id"), F.lit(level).alias("level"), "marking", "h1", "h2", (F.col("next") + F.col("found")).alias("next"))
    seen = Observation()
    refused = F.lit(False) if limit is None else F.col("state_id") >= limit
    out = counted(rows.observe(seen, F.count(F.lit(1)).alias("found"), F.count_if(refused).alias("refused")), "level")
    return out, seen.get["found"], seen.get["refused"]


def _explored(net: Net, moves: DataFrame, chosen, limit: int | None) -> StateGraph:
    """The loop of ``explore``; ``chosen`` filters the enabled transitions of each state.

    A round is one job, which gives the numbered new states; the firings themselves are worked out for all states at once at the end."""
    known_as = hashed(F.col("net_id"), F.col("marking"))
    after = M.fired(F.col("marking"), F.col("gains"), F.col("resets"))

    def firings(states: DataFrame, *more: str) -> DataFrame:
        may = chosen(states.join(moves, F.col("net_id") == F.col("of")).where(M.enabled_at(F.col("marking"), F.col("takes"), F.col("stops"))))
        fired = may.select("net_id", F.col("state_id").alias("src"), "trans_id", after.alias("marking"), "capacity", *more)
        return fired.select("net_id", "src", "trans_id", "marking", M.within(F.col("marking"), F.col("capacity")).alias("fits"), *known_as, *more)

    first = net.initial().select("net_id", F.lit(0).cast("long").alias("state_id"), F.lit(0).alias("level"), "marking", *known_as, F.lit(1).cast("long").alias("next"))
    seen = Observation()
    front, level, cut = counted(first.observe(seen, F.count(F.lit(1)).alias("n")), "level"), 0, None
    size, store = seen.get["n"], StateStore(net.places.sparkSession)
    store.add(front, size)
    while size:
        level += 1
        reached = firings(front, "next").where("fits")
        found = reached.groupBy(*SOUGHT).agg(F.min(F.struct("src", "trans_id")).alias("by"), F.max("next").alias("next"))
        fresh = found.join(store.near(reached), SOUGHT, "left_anti")
        front, found, refused = _numbered(fresh, level, limit, size <= WHOLE)
        if refused:
            over = front.where(F.col("state_id") >= limit).select("net_id")
            cut = over if cut is None else cut.union(over)
            front = front.where(F.col("state_id") < limit)
        size = found - refused
        if size:
            store.add(front, size)
    known = counted(store.every(), "known")
    # states of one net that share both hashes would have to be told apart by their markings; that none do is counted, not supposed
    if not known.groupBy("net_id", "h1", "h2").count().where("count > 1").isEmpty():
        raise RuntimeError("two markings of a net share 128 bits of hash")
    on = known.select("net_id", "h1", "h2", F.col("state_id").alias("dst"))
    tried = counted(firings(known).drop("marking").join(on, ["h1", "h2", "net_id"], "left").select("net_id", "src", "trans_id", "fits", "dst"), "tried")
    edges = tried.where("fits and dst is not null").select("net_id", "src", "trans_id", "dst")
    enabled = tried.groupBy("net_id", F.col("src").alias("state_id")).agg(F.array_sort(F.collect_set("trans_id")).alias("enabled"))
    states = counted(known.join(enabled, ["net_id", "state_id"], "left").select("net_id", "state_id", "level", "marking", F.coalesce("enabled", F.array().cast("array<int>")).alias("enabled")), "states")
    failures = tried.where("not fits").select("net_id", "src", "trans_id", F.lit("capacity").alias("reason"))
    return StateGraph(net, states, edges, failures, cut if cut is not None else states.where("false").select("net_id"))


def explore(net: Net, limit: int | None = 50_000) -> StateGraph:
    """The state graph of each net.  Beyond ``limit`` states of a net no new ones are taken, and the net is marked truncated;
    edges into known states still count, and two transitions between the same states are two edges.

    Inhibitor and reset arcs take part.  A firing that would exceed a capacity is a failure and makes no state."""
    # a net's transitions and capacities are read in every step
    moves = counted(net.moves().join(net.initial().select("net_id", "capacity"), "net_id"), "moves").withColumnRenamed("net_id", "of")
    return _explored(net, moves, lambda may: may, limit)


def explore_reduced(net: Net, limit: int | None = 50_000) -> StateGraph:
    """The state graph with fewer states by a persistent-set rule that keeps every terminal marking.

    Where some enabled transition is the only consumer of its input places, has no inhibitor or reset arc and no capacity in
    reach, firing it alone first loses no terminal marking (it can neither be disabled nor disable another); the
    least such transition is taken, unless it has no effect.  This takes the place of sleep sets, which need the order of a depth-first
    search; states that differ only in the order of independent steps are visited once."""
    w = net.weights()
    takes = w.where("direction in ('in', 'inhibitor', 'reset')").groupBy("net_id", "place_id").agg(F.countDistinct("trans_id").alias("users"))
    special = w.where("direction in ('inhibitor', 'reset')").select("net_id", "place_id").distinct().withColumn("special", F.lit(True))
    bounded = net.places.where("capacity is not null").select("net_id", "place_id").withColumn("bounded", F.lit(True))
    arcs = w.where("direction in ('in', 'out')").join(takes, ["net_id", "place_id"], "left").join(special, ["net_id", "place_id"], "left").join(bounded, ["net_id", "place_id"], "left")
    bad = ((F.col("direction") == "in") & (F.col("users") > 1)) | F.col("special").isNotNull() | ((F.col("direction") == "out") & F.col("bounded").isNotNull())
    moves = net.incidence().groupBy("net_id", "trans_id").agg(F.count("*").alias("n"))
    consuming = net.incidence().where("change < 0").select("net_id", "trans_id").distinct()
    free = arcs.groupBy("net_id", "trans_id").agg(F.max(bad.cast("int")).alias("bad")).where("bad = 0").join(moves, ["net_id", "trans_id"], "left_semi").join(consuming, ["net_id", "trans_id"], "left_semi").groupBy("net_id").agg(F.array_sort(F.collect_set("trans_id")).alias("free"))
    moves = net.moves().join(net.initial().select("net_id", "capacity"), "net_id").join(free, "net_id", "left").withColumn("free", F.coalesce("free", F.array().cast("array<int>")))
    alone = F.min(F.when(F.array_contains("free", F.col("trans_id")), F.col("trans_id"))).over(Window.partitionBy("net_id", "state_id"))
    return _explored(net, counted(moves, "moves").withColumnRenamed("net_id", "of"), lambda may: may.withColumn("alone", alone).where("alone is null or alone = trans_id"), limit)
