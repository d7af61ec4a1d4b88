"""Net reduction: idle loops go, linear sequences become one transition, pass-through places go.

Each rule finds all its matches with joins and applies independent ones at once; chains are followed by pointer doubling.  Every
transition of the result carries ``orig_ids``, the original transitions that it stands for, in order.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.plans.net import Net
from petrelspark.staging import settle


def traced(net: Net) -> Net:
    """The net with ``orig_ids`` on its transitions, and its arcs added up."""
    t = net.transitions
    if "orig_ids" not in t.columns:
        t = t.withColumn("orig_ids", F.array("trans_id"))
    return Net(settle(net.places), settle(t), settle(net.weights()))


def _simple(net: Net) -> DataFrame:
    """Transitions with one input and one output of the same weight: (net_id, trans_id, p, q, weight)."""
    a = net.arcs.groupBy("net_id", "trans_id").agg(F.count_if(F.col("direction") == "in").alias("ins"), F.count_if(F.col("direction") == "out").alias("outs"), F.count("*").alias("n"), F.max(F.when(F.col("direction") == "in", F.col("place_id"))).alias("p"), F.max(F.when(F.col("direction") == "out", F.col("place_id"))).alias("q"), F.min("weight").alias("weight"), F.max("weight").alias("top"))
    return a.where("ins = 1 and outs = 1 and n = 2 and weight = top and p != q").select("net_id", "trans_id", "p", "q", "weight")


def _degrees(net: Net) -> DataFrame:
    """(net_id, place_id, ins, outs, others): arcs into a place, out of it, and special ones."""
    return net.arcs.groupBy("net_id", "place_id").agg(F.count_if(F.col("direction") == "out").alias("ins"), F.count_if(F.col("direction") == "in").alias("outs"), F.count_if(F.col("direction").isin("inhibitor", "reset")).alias("others"))


def _inner(net: Net) -> DataFrame:
    """Places without tokens that aren't resources, with one arc in and one out: they only pass tokens on."""
    return net.places.join(_degrees(net), ["net_id", "place_id"]).where("place_type != 'Resources' and tokens = 0 and ins = 1 and outs = 1 and others = 0").select("net_id", "place_id")


def _without(net: Net, places: DataFrame, transitions: DataFrame) -> Net:
    arcs = net.arcs.join(places, ["net_id", "place_id"], "left_anti").join(transitions, ["net_id", "trans_id"], "left_anti")
    return Net(settle(net.places.join(places, ["net_id", "place_id"], "left_anti")), settle(net.transitions.join(transitions, ["net_id", "trans_id"], "left_anti")), settle(arcs))


def _follow(links: DataFrame) -> DataFrame:
    """Pointer doubling over (net_id, node, next): (net_id, node, last, hops, cyclic); ``last`` is where the links end."""
    at = settle(links.select("net_id", "node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops")))
    count = at.count()
    for _ in range(max(1, count).bit_length() + 1):
        b = at.select("net_id", F.col("node").alias("last"), F.col("last").alias("beyond"), F.col("hops").alias("more"))
        at = settle(at.join(b, ["net_id", "last"], "left").select("net_id", "node", F.coalesce("beyond", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    ends = at.select("net_id", F.col("node").alias("last")).distinct().withColumn("goes_on", F.lit(True))
    return at.join(ends, ["net_id", "last"], "left").select("net_id", "node", "last", "hops", F.coalesce("goes_on", F.lit(False)).alias("cyclic"))


def drop_idle_loops(net: Net) -> Net:
    """Remove cycles of pass-through places and simple transitions that have no token."""
    net = traced(net)
    inner = _inner(net)
    step = _simple(net).join(inner.withColumnRenamed("place_id", "p"), ["net_id", "p"]).join(inner.withColumnRenamed("place_id", "q"), ["net_id", "q"])
    on = settle(_follow(step.select("net_id", F.col("p").alias("node"), F.col("q").alias("next"))).where("cyclic").select("net_id", F.col("node").alias("place_id")))
    gone = settle(step.join(on.withColumnRenamed("place_id", "p"), ["net_id", "p"]).select("net_id", "trans_id"))
    return _without(net, on, gone)


def merge_sequences(net: Net) -> Net:
    """Replace each longest chain of two or more simple transitions of one weight over pass-through places by one transition.

    Its label is theirs where they agree, else Normal.  Cycles are left alone, and places with tokens or resources end a chain.  The head place must have this one way out."""
    net = traced(net)
    inner, simple = _inner(net), settle(_simple(net))
    heads = _degrees(net).where("outs = 1 and others = 0").select("net_id", F.col("place_id").alias("p")).join(net.places.where("place_type != 'Resources'").select("net_id", F.col("place_id").alias("p")), ["net_id", "p"])
    own = simple.join(heads, ["net_id", "p"])
    a, b = own.alias("a"), own.alias("b")
    links = a.join(b, (F.col("a.net_id") == F.col("b.net_id")) & (F.col("a.q") == F.col("b.p")) & (F.col("a.weight") == F.col("b.weight"))).select("a.net_id", F.col("a.trans_id").alias("node"), F.col("b.trans_id").alias("next"), F.col("a.q").alias("place_id")).join(inner, ["net_id", "place_id"])
    links = settle(links.select("net_id", "node", "next", "place_id"))
    chain = _follow(links).where("not cyclic")
    last = chain.select("net_id", F.col("last").alias("node")).distinct().select("net_id", "node", F.col("node").alias("last"), F.lit(0).cast("long").alias("hops"))
    rows = settle(chain.select("net_id", "node", "last", "hops").unionByName(last).join(net.transitions.withColumnRenamed("trans_id", "node"), ["net_id", "node"]).join(own.select("net_id", F.col("trans_id").alias("node"), "p", "q", "weight"), ["net_id", "node"]))
    flat = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("k"), "orig_ids", "name")))
    merged = rows.groupBy("net_id", "last").agg(flat.alias("parts"), F.min_by("node", -F.col("hops")).alias("trans_id"), F.min_by("p", -F.col("hops")).alias("p"), F.max_by("q", -F.col("hops")).alias("q"), F.first("weight").alias("weight"), F.when(F.min("ttype") == F.max("ttype"), F.min("ttype")).otherwise("Normal").alias("label"))
    merged = settle(merged.where("p != q"))  # a chain back to its own head is a cycle
    rows = rows.join(merged.select("net_id", "last"), ["net_id", "last"], "left_semi")
    chain = chain.join(merged.select("net_id", "last"), ["net_id", "last"], "left_semi")
    gone_places = chain.join(links, ["net_id", "node"]).select("net_id", "place_id")
    slim = _without(net, settle(gone_places.distinct()), settle(rows.select("net_id", F.col("node").alias("trans_id"))))
    base = net.transitions.drop("orig_ids", "name", "ttype").join(merged, ["net_id", "trans_id"])
    new = base.select(*[F.array_join(F.transform("parts", lambda x: x["name"]), "+").alias("name") if c == "name" else F.col("label").alias("ttype") if c == "ttype" else F.flatten(F.transform("parts", lambda x: x["orig_ids"])).alias("orig_ids") if c == "orig_ids" else F.col(c) for c in net.transitions.columns])
    arcs = merged.select("net_id", F.col("p").alias("place_id"), "trans_id", F.lit("in").alias("direction"), "weight").union(merged.select("net_id", F.col("q").alias("place_id"), "trans_id", F.lit("out").alias("direction"), "weight"))
    return Net(slim.places, settle(slim.transitions.unionByName(new)), settle(slim.arcs.unionByName(arcs.select(*slim.arcs.columns))))


def drop_intermediate_places(net: Net, max_rounds: int = 1000) -> Net:
    """Join the two transitions around a place without tokens: the first has it as its only output, the second as its only input, by equal weights.

    In each round the matches that share no transition with a smaller one are applied."""
    net = traced(net)
    for _ in range(max_rounds):
        n = net.arcs.groupBy("net_id", "trans_id").agg(F.count_if(F.col("direction") == "in").alias("ins"), F.count_if(F.col("direction") == "out").alias("outs"), F.count_if(F.col("direction").isin("inhibitor", "reset")).alias("others"))
        i, o = net.arcs.where("direction = 'out'").alias("i"), net.arcs.where("direction = 'in'").alias("o")
        same = (F.col("i.net_id") == F.col("o.net_id")) & (F.col("i.place_id") == F.col("o.place_id")) & (F.col("i.weight") == F.col("o.weight"))
        pair = i.join(o, same).where("i.trans_id != o.trans_id").select("i.net_id", "i.place_id", F.col("i.trans_id").alias("t1"), F.col("o.trans_id").alias("t2")).join(_inner(net), ["net_id", "place_id"])
        pair = pair.join(n.select("net_id", F.col("trans_id").alias("t1"), F.col("outs").alias("o1"), F.col("others").alias("x1")), ["net_id", "t1"]).join(n.select("net_id", F.col("trans_id").alias("t2"), F.col("ins").alias("i2"), F.col("others").alias("x2")), ["net_id", "t2"])
        pair = settle(pair.where("o1 = 1 and i2 = 1 and x1 = 0 and x2 = 0").select("net_id", "place_id", "t1", "t2"))
        sides = lambda way, t: net.arcs.where(F.col("direction") == way).groupBy("net_id", F.col("trans_id").alias(t)).agg(F.collect_set("place_id").alias(f"{way}_of"))
        # two transitions that only lead back to where they came from are a cycle
        pair = settle(pair.join(sides("in", "t1"), ["net_id", "t1"], "left").join(sides("out", "t2"), ["net_id", "t2"], "left").where("out_of is null or in_of is null or size(array_except(out_of, in_of)) > 0").select("net_id", "place_id", "t1", "t2"))
        uses = pair.select("net_id", "place_id", F.explode(F.array("t1", "t2")).alias("t"))
        least = uses.groupBy("net_id", "t").agg(F.min("place_id").alias("least"))
        lost = uses.join(least, ["net_id", "t"]).where("place_id > least").select("net_id", "place_id").distinct()
        chosen = settle(pair.join(lost, ["net_id", "place_id"], "left_anti"))
        if chosen.isEmpty():
            return net
        second = net.transitions.select("net_id", F.col("trans_id").alias("t2"), F.col("orig_ids").alias("orig2"), F.col("name").alias("name2"), F.col("ttype").alias("ttype2"))
        joined = net.transitions.join(chosen.withColumnRenamed("t1", "trans_id").drop("place_id"), ["net_id", "trans_id"]).join(second, ["net_id", "t2"])
        label = F.when(F.col("ttype") == F.col("ttype2"), F.col("ttype")).otherwise("Normal")
        new = joined.select(*[F.concat_ws("+", "name", "name2").alias("name") if c == "name" else label.alias("ttype") if c == "ttype" else F.concat("orig_ids", "orig2").alias("orig_ids") if c == "orig_ids" else F.col(c) for c in net.transitions.columns])
        moved = net.arcs.join(chosen.select("net_id", F.col("t2").alias("trans_id"), "t1"), ["net_id", "trans_id"]).where("direction = 'out'").select("net_id", "place_id", F.col("t1").alias("trans_id"), "direction", "weight")
        places = chosen.select("net_id", "place_id")
        kept = net.arcs.join(places, ["net_id", "place_id"], "left_anti").join(chosen.select("net_id", F.col("t2").alias("trans_id")), ["net_id", "trans_id"], "left_anti")
        rest = net.transitions.join(chosen.select("net_id", F.col("t1").alias("trans_id")), ["net_id", "trans_id"], "left_anti").join(chosen.select("net_id", F.col("t2").alias("trans_id")), ["net_id", "trans_id"], "left_anti")
        arcs = kept.unionByName(moved).groupBy("net_id", "place_id", "trans_id", "direction").agg(F.sum("weight").alias("weight"))
        net = Net(settle(net.places.join(places, ["net_id", "place_id"], "left_anti")), settle(rest.unionByName(new)), settle(arcs))
    raise RuntimeError(f"reduction did not settle in {max_rounds} rounds")


def renumbered(net: Net) -> Net:
    """The net with dense ids in the order of the old ones; ``orig_ids`` stay."""
    p = net.places.withColumn("new", (F.row_number().over(Window.partitionBy("net_id").orderBy("place_id")) - 1).cast("int"))
    t = net.transitions.withColumn("new", (F.row_number().over(Window.partitionBy("net_id").orderBy("trans_id")) - 1).cast("int"))
    arcs = net.arcs.join(p.select("net_id", "place_id", F.col("new").alias("np")), ["net_id", "place_id"]).join(t.select("net_id", "trans_id", F.col("new").alias("nt")), ["net_id", "trans_id"]).select("net_id", F.col("np").alias("place_id"), F.col("nt").alias("trans_id"), "direction", "weight")
    put = lambda d, key: d.select(*[F.col("new").alias(key) if c == key else F.col(c) for c in d.columns if c != "new"])
    return Net(settle(put(p, "place_id")), settle(put(t, "trans_id")), settle(arcs))


def reduced(net: Net, validators: tuple = (), repeat: bool = False) -> dict[str, Net]:
    """The net after each stage: loops, sequences, intermediate, and result, renumbered.

    Each rule runs once, or again until nothing changes with ``repeat``; every validator is called with the net after each stage and may raise."""
    stages: dict[str, Net] = {}
    now = traced(net)
    while True:
        before = now.places.count() + now.transitions.count()
        for name, rule in (("loops", drop_idle_loops), ("sequences", merge_sequences), ("intermediate", drop_intermediate_places)):
            now = stages[name] = rule(now)
            for check in validators:
                check(now)
        if not repeat or now.places.count() + now.transitions.count() == before:
            break
    stages["result"] = renumbered(now)
    return stages


def restored(path: DataFrame, net: Net) -> DataFrame:
    """A path (net_id, pos, trans_id) of the reduced net in original transitions: (net_id, pos, original)."""
    return path.join(replace(net).transitions.select("net_id", "trans_id", "orig_ids"), ["net_id", "trans_id"]).select("net_id", "pos", F.explode("orig_ids").alias("original"))
