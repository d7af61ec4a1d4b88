"""Detectors over state graphs and access tables: deadlocks, data races, atomicity violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.functions.classify import ALLOWED_STORES
from petrelspark.operators.closure import reachable
from petrelspark.operators.explore import StateGraph
from petrelspark.plans.net import Net
from petrelspark.staging import counted, settle


def _ended(graph: StateGraph, semantics: str, entry: str) -> DataFrame:
    """States of normal termination: the entry function's end is marked (strict), or some place with its end in the name (compat)."""
    at = graph.snapshots()
    end = at["name"].contains(f"{entry}_end")
    return at.where(end if semantics == "compat" else end & (at["place_type"] == "FunctionEnd")).select("net_id", "state_id").distinct()


def deadlocks(graph: StateGraph, semantics: str = "strict", entry: str = "main") -> DataFrame:
    """(net_id, state_id, reason, marking): states without an outgoing edge that are not normal termination.

    ``reason``: no_enabled, capacity (every firing would overflow) or truncated (successors were refused).  ``marking``: the marked
    places as ``name:tokens``, by name; compat shows 255 tokens at most."""
    left = graph.states.join(graph.moving(), ["net_id", "state_id"], "left_anti")
    left = left.join(_ended(graph, semantics, entry), ["net_id", "state_id"], "left_anti")
    failed = graph.failures.select("net_id", F.col("src").alias("state_id")).distinct().withColumn("failed", F.lit(True))
    reason = F.when(F.size("enabled") == 0, "no_enabled").when(F.col("failed"), "capacity").otherwise("truncated")
    marked = graph.snapshots().groupBy("net_id", "state_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", (F.least("tokens", F.lit(255)) if semantics == "compat" else F.col("tokens")).cast("string")))), ",").alias("marks"))
    return left.join(failed, ["net_id", "state_id"], "left").join(marked, ["net_id", "state_id"], "left").select("net_id", "state_id", reason.alias("reason"), F.coalesce("marks", F.lit("")).alias("marking"))


def deadlock_report(graph: StateGraph, semantics: str = "strict", entry: str = "main") -> DataFrame:
    """``deadlocks`` with the transitions that first led there, by name."""
    names = graph.net.transitions.select("net_id", "trans_id", "name")
    steps = graph.paths().select("net_id", "state_id", F.posexplode("path").alias("pos", "trans_id")).join(names, ["net_id", "trans_id"])
    path = steps.groupBy("net_id", "state_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("p")).select("net_id", "state_id", F.transform("p", lambda x: x["name"]).alias("path"))
    return deadlocks(graph, semantics, entry).join(path, ["net_id", "state_id"], "left")


def closed_sets(graph: StateGraph, max_rounds: int = 100_000) -> DataFrame:
    """(net_id, state, set): the states of closed sets, which reach each other and nothing else; ``set`` is the largest state of each.

    Each state is labelled with the largest state that it reaches.  A state with its own label reaches a closed set and no more exactly if all that it
    reaches has its label, so the walk from such states stays within one label and takes no state twice."""
    e = counted(graph.edges.select("net_id", "src", "dst").distinct(), "arrows")
    labels = counted(graph.states.select("net_id", F.col("state_id").alias("state"), F.col("state_id").alias("label")), "labels")
    for _ in range(max_rounds):
        ahead = e.join(labels.withColumnRenamed("state", "dst"), ["net_id", "dst"]).groupBy("net_id", F.col("src").alias("state")).agg(F.max("label").alias("far"))
        moved = counted(labels.join(ahead, ["net_id", "state"], "left").select("net_id", "state", F.greatest("label", F.coalesce("far", "label")).alias("label"), (F.col("far") > F.col("label")).alias("new")), "labels")
        labels = moved.drop("new")
        if moved.where("new").isEmpty():
            break
    on = lambda c: labels.select("net_id", F.col("state").alias(c), F.col("label").alias(f"{c}_label"))
    arrows = counted(e.join(on("src"), ["net_id", "src"]).join(on("dst"), ["net_id", "dst"]), "arrows")
    inside = arrows.where("src_label = dst_label").select("net_id", "src", "dst")
    roots = labels.where("state = label").select("net_id", F.col("state").alias("root"), F.col("state").alias("node"))
    reached = counted(reachable(inside, roots, ["net_id"]).select("net_id", F.col("node").alias("state"), F.col("root").alias("set")), "reached")
    leaves = arrows.where("src_label != dst_label").select("net_id", F.col("src").alias("state")).distinct()
    open_ = reached.join(leaves, ["net_id", "state"]).select("net_id", "set").distinct()
    idle = labels.where("state = label").join(e.select("net_id", F.col("src").alias("state")).distinct(), ["net_id", "state"], "left_anti").select("net_id", F.col("state").alias("set"))
    return reached.join(open_, ["net_id", "set"], "left_anti").join(idle, ["net_id", "set"], "left_anti").select("net_id", "state", "set")


def blocked_cycles(graph: StateGraph) -> DataFrame:
    """(net_id, state_id, locks, states): closed sets of states that reach each other and nothing else, in which some but not
    all locks can never be taken; ``state_id`` is the least state of a set.  Sets of one state without an edge are no cycle.

    It is meant for nets in which no state is a deadlock (see ``of_nets``), and needs Lock, RwLockRead or RwLockWrite labels."""
    members = counted(closed_sets(graph), "closed")
    locks = graph.net.transitions.where("ttype in ('Lock', 'RwLockRead', 'RwLockWrite')").select("net_id", "trans_id", F.col("res_place").alias("lock"))
    every = locks.groupBy("net_id").agg(F.array_sort(F.collect_set("lock")).alias("every"))
    can = members.join(graph.states.select("net_id", F.col("state_id").alias("state"), F.explode_outer("enabled").alias("trans_id")), ["net_id", "state"]).join(locks, ["net_id", "trans_id"], "left").groupBy("net_id", "set").agg(F.collect_set("lock").alias("can"), F.countDistinct("state").alias("states"), F.min("state").alias("least"))
    blocked = can.join(every, "net_id").withColumn("locks", F.array_except("every", "can"))
    return blocked.where("size(locks) > 0 and size(array_except(every, locks)) > 0").groupBy("net_id", "locks").agg(F.min("least").alias("state_id"), F.min_by("states", "least").alias("states"))


def of_nets(graph: StateGraph, nets: DataFrame, but: bool = False) -> StateGraph:
    """The graph of some nets (net_id), or of all others."""
    keep = lambda d: d.join(nets.select("net_id").distinct(), "net_id", "left_anti" if but else "left_semi")
    return StateGraph(Net(keep(graph.net.places), keep(graph.net.transitions), keep(graph.net.arcs)), keep(graph.states), keep(graph.edges), keep(graph.failures), keep(graph.truncated), graph.every_edge)


def accesses(graph: StateGraph) -> DataFrame:
    """The unsafe reads and writes of each state's outgoing edges, in the form that ``race_pairs`` takes."""
    t = graph.net.transitions.where("ttype in ('UnsafeRead', 'UnsafeWrite')").select("net_id", "trans_id", F.col("var").alias("location"), (F.col("ttype") == "UnsafeWrite").alias("write"), F.col("basic_block").alias("block"), "span", "ttype")
    e = graph.edges.select("net_id", "src", "trans_id").distinct().join(t, ["net_id", "trans_id"])
    return e.select("net_id", F.col("src").alias("state"), "location", "write", "block", "span", F.col("ttype").alias("op"), F.col("trans_id").cast("long").alias("ord"))


def race_pairs(access: DataFrame, keys: list[str] | None = None, different_threads: bool = False) -> DataFrame:
    """Pairs of accesses of one state to one location, at least one of them a write: the columns of both with a_ and b_, a before b by ``ord``.

    The join starts from the writes, so two reads never meet; accesses with a null location or order are left out."""
    keys = [*(keys or []), "state", "location"]
    a = access.where("location is not null and ord is not null")
    rest = [c for c in a.columns if c not in keys]
    x, y = a.where("write").select(*keys, *[F.col(c).alias(f"x_{c}") for c in rest]), a.select(*keys, *[F.col(c).alias(f"y_{c}") for c in rest])
    # a pair of two writes is taken once, from its first; a write and a read from the write
    apart = F.col("x_ord") != F.col("y_ord")
    pairs = x.join(y, keys).where(apart & (~F.col("y_write") | (F.col("x_ord") < F.col("y_ord"))))
    if different_threads:
        pairs = pairs.where(F.col("x_thread") != F.col("y_thread"))
    first = F.col("x_ord") < F.col("y_ord")
    side = lambda c, mine, other: F.when(first, F.col(f"{mine}_{c}")).otherwise(F.col(f"{other}_{c}"))
    return pairs.select(*keys, *[side(c, "x", "y").alias(f"a_{c}") for c in rest], *[side(c, "y", "x").alias(f"b_{c}") for c in rest])


def race_counts(access: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(location, pairs, states): how many pairs of ``race_pairs`` by different threads each location has, and in how many states.

    Of n accesses with r reads, n(n-1)/2 - r(r-1)/2 pairs have a write; those within one thread are taken off.  So no pair is made."""
    keys = keys or []
    pairs = lambda n, r: (F.col(n) * (F.col(n) - 1) - F.col(r) * (F.col(r) - 1)) / 2
    a = access.where("location is not null and ord is not null and thread is not null")
    own = a.groupBy(*keys, "state", "location", "thread").agg(F.count("*").alias("n"), F.count_if(~F.col("write")).alias("r"))
    of = own.groupBy(*keys, "state", "location").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum(pairs("n", "r")).alias("same"))
    return of.withColumn("k", (pairs("n", "r") - F.col("same")).cast("long")).where("k > 0").groupBy(*keys, "location").agg(F.sum("k").alias("pairs"), F.countDistinct("state").alias("states"))


def merged_races(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One race for each location, block and span of the first access: its number of pairs, and of each type of operation the
    first that took part, by (state, order)."""
    by = [*(keys or []), "location", F.col("a_block").alias("block"), F.col("a_span").alias("span")]
    ops = F.explode(F.array(F.struct(F.col("a_op").alias("op"), F.struct("state", F.col("a_ord").alias("ord")).alias("at"), F.col("a_span").alias("where")), F.struct(F.col("b_op").alias("op"), F.struct("state", F.col("b_ord").alias("ord")).alias("at"), F.col("b_span").alias("where"))))
    rows = pairs.select(*by, ops.alias("o"))
    names = [*(keys or []), "location", "block", "span"]
    firsts = rows.groupBy(*names, "o.op").agg(F.min_by("o.where", "o.at").alias("where"), F.count("*").alias("n"))
    return firsts.groupBy(*names).agg((F.sum("n") / 2).cast("long").alias("pairs"), F.array_sort(F.collect_list(F.concat_ws("@", "op", "where"))).alias("operations"))


def compatible(load: Column, store: Column) -> Column:
    """If a load of one ordering may see a store of another."""
    out = F.lit(False)
    for k, stores in ALLOWED_STORES.items():
        if stores:
            out = out | ((load == k) & store.isin(stores))
    return out


def atomicity(graph: StateGraph) -> DataFrame:
    """(net_id, var, load, stores): loads that may see two or more different stores of a compatible ordering, with the spans of both.

    A store is seen where a walk over edges leads from it to the load without a step that starts a function; each store, of which
    there are few, walks on from the states that it leads to."""
    t = graph.net.transitions
    e = graph.edges.join(t.select("net_id", "trans_id", "ttype", "var", "ordering", "span"), ["net_id", "trans_id"])
    loads = e.where("ttype = 'AtomicLoad'").select("net_id", F.col("trans_id").alias("load_id"), F.col("src").alias("node"), F.col("var").alias("v"), F.col("ordering").alias("load_order"), F.col("span").alias("load_span")).distinct()
    stores = e.where("ttype in ('AtomicStore', 'AtomicCmpXchg')").select("net_id", F.col("trans_id").alias("root"), F.col("dst").alias("node")).distinct()
    seen = reachable(e.where("ttype != 'Start'").select("net_id", "src", "dst"), stores, ["net_id"]).select("net_id", "root", "node")
    about = t.select("net_id", F.col("trans_id").alias("root"), F.col("var").alias("v"), "ordering", "span")
    hits = loads.join(seen, ["net_id", "node"]).join(about, ["net_id", "root", "v"]).where(compatible(F.col("load_order"), F.col("ordering")))
    found = hits.groupBy("net_id", F.col("v").alias("var"), F.col("load_span").alias("load"), "node").agg(F.array_sort(F.collect_set("span")).alias("stores")).where("size(stores) >= 2")
    return found.select("net_id", "var", "load", "stores").distinct()


def store_sets(ops: DataFrame) -> DataFrame:
    """Of a table (state, var, kind, ordering, span): each load with the distinct compatible stores of its state and variable, two or more."""
    load = ops.where("kind = 'load'").select("state", "var", F.col("span").alias("load"), F.col("ordering").alias("load_order")).distinct()
    store = ops.where("kind = 'store'").select("state", "var", "span", "ordering").distinct()
    hits = load.join(store, ["state", "var"]).where(compatible(F.col("load_order"), F.col("ordering")))
    return hits.groupBy("state", "var", "load").agg(F.array_sort(F.collect_set("span")).alias("stores")).where("size(stores) >= 2")


def net_witnesses(graph: StateGraph, max_states: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Pattern search on the net: (net_id, rule, var, start, mid, end), transitions that fire in this order along some path, with nothing
    of the rule between that would replace them.

    ``max_states``: how many (state, automaton) nodes a net may have; beyond that the least ones of a step are taken, and none later.  ``max_depth``:
    the steps that are followed.  Both hold for each net by itself, so a net alone gives what it gives among others.

    The frontier is over (state, automaton): the automaton of a rule, variable and thread keeps the start and the middle transition
    seen last, by transition id, so the space is finite."""
    from petrelspark.operators.sequence import RULES, event_kind

    t = graph.net.transitions.withColumn("kind", event_kind(F.col("ttype"))).select("net_id", "trans_id", F.col("var").alias("v"), "tid", "kind")
    e = settle(graph.edges.join(t, ["net_id", "trans_id"]).select(F.col("net_id").alias("net"), "src", "dst", "trans_id", "v", "tid", "kind"))
    threads = e.where("kind is not null").select(F.col("net").alias("net_id"), F.col("v").alias("var"), F.col("tid").alias("i")).distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), *[F.lit(x).alias(n) for x, n in zip(v, ("s", "m", "e"), strict=True)]) for k, v in RULES.items()]))
    if max_states is None:
        # a pattern needs a load of its thread and a store of another one; with a budget all others count, too
        done = lambda kind, tid: e.where(F.col("kind") == kind).select(F.col("net").alias("net_id"), F.col("v").alias("var"), F.col("tid").alias(tid)).distinct()
        threads = threads.join(done("load", "i"), ["net_id", "var", "i"], "left_semi").join(done("store", "j"), ["net_id", "var"]).where("i != j").select("net_id", "var", "i").distinct()
    start = threads.select("*", kinds.alias("r")).select("net_id", "var", "i", "r.*", F.lit(0).cast("long").alias("state"), F.lit(-1).alias("first"), F.lit(-1).alias("mid"))
    key = ["net_id", "var", "i", "rule", "s", "m", "e", "state", "first", "mid"]
    node = ["net_id", "var", "i", "rule", "state", "first", "mid"]  # the rule has the rest

    def admitted(fresh: DataFrame, had: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The new nodes that the nets' budgets take, in the order of the nodes, and how many each net has then."""
        if max_states is None:
            return settle(fresh.select(*key)), None
        order = Window.partitionBy("net_id").orderBy("rule", "var", "i", "state", "first", "mid")
        ranked = fresh.withColumn("rank", F.row_number().over(order))
        if had is not None:
            ranked = ranked.join(had, "net_id", "left")
        before = F.coalesce("n", F.lit(0)) if had is not None else F.lit(0)
        new = settle(ranked.where(F.col("rank") + before <= max_states).select(*key))
        sums = new.groupBy("net_id").agg(F.count("*").alias("n"))
        return new, settle(sums if had is None else had.union(sums).groupBy("net_id").agg(F.sum("n").alias("n")))

    front, had = admitted(start.select(*key), None)
    seen, rounds = [front], 0
    mine = F.coalesce((F.col("v") == F.col("var")) & (F.col("tid") == F.col("i")), F.lit(False))
    other = F.coalesce((F.col("v") == F.col("var")) & (F.col("tid") != F.col("i")), F.lit(False))
    ends = mine & (F.col("kind") == F.col("e")) & (F.col("first") >= 0)
    starts, mids = mine & (F.col("kind") == F.col("s")), other & (F.col("kind") == F.col("m")) & (F.col("first") >= 0)
    out = []
    while not front.isEmpty() and (max_depth is None or rounds < max_depth):
        rounds += 1
        step = front.join(e, (F.col("net_id") == F.col("net")) & (F.col("state") == F.col("src")))
        out.append(settle(step.where(ends & (F.col("mid") >= 0)).select("net_id", "rule", "var", F.col("first").alias("start"), "mid", F.col("trans_id").alias("end")).distinct()))
        moved = step.select("net_id", "var", "i", "rule", "s", "m", "e", F.col("dst").alias("to"), F.when(starts, F.col("trans_id")).otherwise(F.col("first")).alias("f2"), F.when(starts | ends, F.lit(-1)).when(mids, F.col("trans_id")).otherwise(F.col("mid")).alias("m2"))
        fresh = moved.distinct().toDF(*key).join(reduce(DataFrame.union, seen), node, "left_anti")
        front, had = admitted(fresh, had)
        seen.append(front)
        if len(seen) >= 16:
            seen = [settle(reduce(DataFrame.union, seen))]
    none = start.select("net_id", "rule", "var", F.col("first").alias("start"), "mid", F.col("mid").alias("end")).where("false")
    return reduce(DataFrame.union, out, none).distinct()


def pattern_records(witnesses: DataFrame, transitions: DataFrame) -> DataFrame:
    """``net_witnesses`` with the variable's data type and, of each of the three operations, its name, kind, thread, ordering and place in the text."""
    out = witnesses
    for part in ("start", "mid", "end"):
        t = transitions.select("net_id", F.col("trans_id").alias(part), F.struct("name", "ttype", "tid", "ordering", "span").alias(f"{part}_op"), *([F.col("data_type")] if part == "start" else []))
        out = out.join(t, ["net_id", part])
    return out.select("net_id", "rule", "var", "data_type", "start_op", "mid_op", "end_op")
