"""Literal nets against rows that were worked out apart from the engine."""

import pytest
from pyspark.sql import functions as F

from petrelspark.operators import antichain, detect, explore, sleep
from petrelspark.plans import expected, fixtures, order_nets


@pytest.fixture(scope="module")
def graph(spark):
    return explore.explore(fixtures.net(spark))


def csv(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def same(df, name):
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, expected.ROWS[name][1])), name


def test_limits_and_reduced_graphs(spark):
    same(explore.explore(fixtures.net(spark), limit=3).stats(), "reach_truncated")
    same(explore.explore_reduced(fixtures.net(spark)).stats(), "reach_reduced")


def test_reports(spark, graph):
    same(detect.deadlock_report(graph).withColumn("path", F.array_join("path", ",")), "deadlock_report")
    same(detect.blocked_cycles(explore.explore(fixtures.net(spark, fixtures.SPINNING))).select("net_id", csv("locks").alias("locks"), "states"), "deadlock_cycles")
    same(detect.atomicity(graph).withColumn("stores", F.array_join("stores", ",")), "atomicity_on_net")
    same(detect.net_witnesses(graph), "atomicity_search")


ORDERS = [(k, "OPF"[k % 3], "5-LOW" if k % 2 else "1-URGENT") for k in range(8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few orders with up to four line items each."""
    top = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{top}/orders.parquet")
    lines = [(k, 7 * k + j, (k + 2 * j) % 5, j, 1.0, 2.0, 0.0, 0.0, "NNRA"[(k + j) % 4], "OF"[j % 2]) for k in range(1, 8) for j in range(k % 5)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{top}/lineitem.parquet")
    return top


def collected(net):
    places, caps, pre, post = {}, {}, {}, {}
    for r in net.places.collect():
        places.setdefault(r["net_id"], {})[r["place_id"]] = r["tokens"]
        caps.setdefault(r["net_id"], {})[r["place_id"]] = r["capacity"]
    for r in net.weights().collect():
        (pre if r["direction"] == "in" else post).setdefault((r["net_id"], r["trans_id"]), {})[r["place_id"]] = r["weight"]
    trans = {}
    for r in net.transitions.collect():
        trans.setdefault(r["net_id"], []).append(r["trans_id"])
    return places, caps, pre, post, trans


def walked(n, places, caps, pre, post, trans):
    start = tuple(places[n][p] for p in sorted(places[n]))
    found, todo, edges = {start}, [start], 0
    while todo:
        m = todo.pop()
        for t in trans[n]:
            a, b = pre.get((n, t), {}), post.get((n, t), {})
            if all(m[p] >= w for p, w in a.items()):
                after = tuple(x - a.get(p, 0) + b.get(p, 0) for p, x in enumerate(m))
                if all(caps[n][p] is None or x <= caps[n][p] for p, x in enumerate(after)):
                    edges += 1
                    if after not in found:
                        found.add(after)
                        todo.append(after)
    return found, edges


def test_nets_of_orders(spark, folder):
    net = order_nets.nets(spark, folder)
    parts = collected(net)
    g, less = explore.explore(net), sleep.explore_asleep(net)
    states, asleep = ({(r["net_id"], tuple(r["marking"])) for r in x.states.collect()} for x in (g, less))
    stats = {r["net_id"]: r for r in g.stats().collect()}
    for k, *_ in ORDERS:
        found, edges = walked(str(k), *parts)
        assert {m for n, m in states if n == str(k)} == found == {m for n, m in asleep if n == str(k)} and stats[str(k)]["edges"] == edges
    assert less.edges.count() < g.edges.count()


def tree(n, places, caps, pre, post, trans):
    """Karp and Miller's tree, with every ancestor: the maximal markings, ω as infinity."""
    top, found = float("inf"), set()
    stack = [(tuple(places[n][p] for p in sorted(places[n])),)]
    while stack:
        line = stack.pop()
        m = line[-1]
        found.add(m)
        if m in line[:-1]:
            continue
        for t in trans[n]:
            a, b = pre.get((n, t), {}), post.get((n, t), {})
            if all(m[p] >= w for p, w in a.items()):
                after = [x - a.get(p, 0) + b.get(p, 0) for p, x in enumerate(m)]
                for old in line:
                    if all(x >= y for x, y in zip(after, old, strict=True)) and tuple(after) != old:
                        after = [top if x > y else x for x, y in zip(after, old, strict=True)]
                stack.append((*line, tuple(after)))
    return {m for m in found if not any(m != o and all(x <= y for x, y in zip(m, o, strict=True)) for o in found)}


def test_maximal_markings_of_orders(spark, folder):
    net = order_nets.nets(spark, folder, ticking=True)
    parts = collected(net)
    got = {}
    for r in antichain.minimal_coverability(net).where("maximal").collect():
        got.setdefault(r["net_id"], set()).add(tuple(float("inf") if x is None else x for x in r["marking"]))
    assert got == {str(k): tree(str(k), *parts) for k, *_ in ORDERS} and any(float("inf") in m for s in got.values() for m in s)
