"""Literal nets against known results, and random nets against a small simulator."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from petrelspark.functions import markings as M
from petrelspark.operators import boundness, detect, explore, reduce
from petrelspark.plans import fixtures
from petrelspark.plans.analysis import analyse

#: net -> states, edges, terminal states, reported states, capacity failures
GOLDEN = {"N1": (2, 1, {1}, {1}, 0), "N2": (2, 2, set(), set(), 0), "N4": (2, 1, {1}, {1}, 0), "N5": (1, 2, set(), set(), 0), "N6": (1, 3, set(), set(), 0), "N7": (15, 16, {5, 14}, {5}, 0), "N8": (14, 14, {13}, set(), 0), "N9": (2, 1, set(), {1}, 1), "N10": (3, 2, {2}, set(), 0), "N11": (4, 4, {3}, {3}, 0)}


@pytest.fixture(scope="module")
def graph(spark):
    return explore.explore(fixtures.net(spark))


def by_net(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(r["net_id"], []).append(tuple(r[n] for n in names))
    return out


def test_golden_graphs(graph):
    stats = {r["net_id"]: r for r in graph.stats().collect()}
    terminal = by_net(graph.terminal().collect(), "state_id")
    reported = by_net(detect.deadlocks(graph).collect(), "state_id", "reason", "marking")
    failures = by_net(graph.failures.collect(), "src")
    for net, (states, edges, ends, found, failed) in GOLDEN.items():
        assert (stats[net]["states"], stats[net]["edges"], stats[net]["deadlocks"], stats[net]["truncated"]) == (states, edges, len(ends), False), net
        assert {s for s, in terminal.get(net, [])} == ends and {s[0] for s in reported.get(net, [])} == found and len(failures.get(net, [])) == failed, net
    assert reported["N7"] == [(5, "no_enabled", "a1:1,b1:1,main_wait:1")] and reported["N9"][0][1] == "capacity"


def test_paths_changes_and_reports(graph):
    report = {r["net_id"]: r for r in detect.deadlock_report(graph).collect()}
    assert report["N7"]["path"] == ["spawn", "a_lock0", "b_lock1"]
    assert graph.changes().where("net_id = 'N1'").select("place_id", "delta").orderBy("place_id").collect() == [(0, -1), (1, 1)]
    compat = detect.deadlocks(graph, "compat").where("net_id = 'N7'").collect()
    assert [r["state_id"] for r in compat] == [5]


def test_races_and_atomicity(graph):
    races = detect.merged_races(detect.race_pairs(detect.accesses(graph), ["net_id"]), ["net_id"]).collect()
    assert [(r["net_id"], len(r["operations"]), any("Write" in o for o in r["operations"])) for r in races] == [("N5", 2, True)]
    found = detect.atomicity(graph).collect()
    assert [(r["net_id"], r["stores"]) for r in found] == [("N6", ["10:5", "12:5"])]
    assert {(r["rule"], r["start"], r["mid"], r["end"]) for r in detect.net_witnesses(graph).collect()} >= {(3, 2, 1, 2)}


def test_limit(spark):
    g = explore.explore(fixtures.net(spark, {"N1": fixtures.NETS["N1"]}), limit=1)
    assert g.stats().first()[1:] == (1, 0, 0, True)
    d = detect.deadlocks(g).collect()
    assert [(r["state_id"], r["reason"]) for r in d] == [(0, "truncated")]


def test_blocked_cycle(spark):
    # a thread spins on a flag that the owner of a lock, who waits for another lock, never sets
    nets = {"spin": (["s0:1/1", "s1:0/1", "A:0/1!Resources", "B:1/1!Resources", "w:1/1"], ["go: s0 -> s1", "back: s1 -> s0", "lockA!Lock@2: w + A -> w + A", "lockB!Lock@3: s1 + B -> s1 + B"])}
    g = explore.explore(fixtures.net(spark, nets))
    assert [(r["locks"], r["state_id"], r["states"]) for r in detect.blocked_cycles(g).collect()] == [([2], 0, 2)]


def simulate(net, limit=3000):
    _, _, arcs = fixtures.rows({"x": net})
    places, trans, _ = fixtures.rows({"x": net})
    n = len(places)
    caps = [p[4] for p in places]
    pre, post = ([[0] * n for _ in trans] for _ in range(2))
    for _, p, t, way, w in arcs:
        (pre if way == "in" else post)[t][p] += w
    start = tuple(p[3] for p in places)
    ids, queue, edges = {start: 0}, deque([start]), []
    while queue:
        m = queue.popleft()
        for t in range(len(trans)):
            if all(x >= y for x, y in zip(m, pre[t], strict=True)):
                after = tuple(x - a + b for x, a, b in zip(m, pre[t], post[t], strict=True))
                if any(c is not None and x > c for x, c in zip(after, caps, strict=True)):
                    continue
                if after not in ids:
                    ids[after] = len(ids)
                    queue.append(after)
                edges.append((ids[m], t, ids[after]))
    return ids, sorted(edges)


def random_nets(seed, n=6, capacity=2):
    r = random.Random(seed)
    out = {}
    for k in range(n):
        names = [f"p{i}" for i in range(r.randrange(2, 6))]
        places = [f"{p}:{r.randrange(0, 2)}/{capacity}" for p in names]
        side = lambda: " + ".join(f"{r.choice([1, 1, 1, 2])}*{p}" for p in r.sample(names, r.randrange(1, min(3, len(names)) + 1)))
        out[f"r{k}"] = (places, [f"t{i}: {side()} -> {side()}" for i in range(r.randrange(1, 5))])
    return out


def test_random_nets(spark):
    nets = random_nets(11)
    net = fixtures.net(spark, nets)
    g, less = explore.explore(net), explore.explore_reduced(net)
    states, edges = by_net(g.states.collect(), "state_id", "marking"), by_net(g.edges.collect(), "src", "trans_id", "dst")
    terminal = lambda x: {(r["net_id"], tuple(r["marking"])) for r in x.states.join(x.edges.select("net_id", F.col("src").alias("state_id")), ["net_id", "state_id"], "left_anti").collect()}
    for k, n in nets.items():
        ids, want = simulate(n)
        assert {tuple(m): i for i, m in states[k]} == ids and sorted(edges.get(k, [])) == want
    assert terminal(g) == terminal(less)


def test_reduced_exploration_is_smaller_and_sound(spark):
    free = {"free": (["p0:1/-", "p1:0/-", "q0:1/-", "q1:0/-", "r0:1/-", "r1:0/-"], ["a: p0 -> p1", "b: q0 -> q1", "c: r0 -> r1"]), "N11": fixtures.NETS["N11"], "N7": fixtures.NETS["N7"]}
    g = explore.explore_reduced(fixtures.net(spark, free))
    n = {r["net_id"]: r for r in g.stats().collect()}
    assert n["free"]["states"] == 4 and n["free"]["deadlocks"] == 1
    assert {(r["net_id"], r["marking"]) for r in detect.deadlocks(g).collect()} >= {("N7", "a1:1,b1:1,main_wait:1"), ("N11", "p1:1,q1:1")}


def test_special_arcs(spark):
    net = fixtures.net(spark, fixtures.SPECIAL)
    on = net.initial().join(net.firing(), "net_id").where(M.enabled(F.col("marking"), F.col("pre"), F.col("inhibitor")))
    assert {(r["net_id"], r["trans_id"]) for r in on.collect()} == {("inhibited", 1), ("inhibited", 2), ("resetting", 0), ("resetting", 1)}
    fired = on.where("net_id = 'resetting' and trans_id = 0").select(M.fire(F.col("marking"), F.col("pre"), F.col("post"), F.col("reset"))).first()[0]
    assert fired == [0, 0, 1]


def test_arcs_add_up_and_empty_nets(spark):
    net = fixtures.net(spark, {"N1": fixtures.NETS["N1"]}).with_rows(spark, arcs=[("N1", 0, 0, "in", 2), ("N1", 1, 0, "out", 0)])
    assert {(r["place_id"], r["direction"], r["weight"]) for r in net.weights().collect()} == {(0, "in", 3), (1, "out", 1)}
    assert {(r["place_id"], r["weight"]) for r in net.set_arcs(spark, [("N1", 0, 0, "in", 5)]).weights().collect()} == {(0, 5), (1, 1)}
    empty = type(net).empty(spark)
    assert explore.explore(empty).stats().count() == 0 and empty.diagnosis().count() == 0


def test_reduction(spark):
    stages = reduce.reduced(fixtures.net(spark, fixtures.REDUCIBLE))
    size = lambda n: {k: (len(p), len(t)) for k, p, t in ((k, [1 for r in n.places.collect() if r["net_id"] == k], [1 for r in n.transitions.collect() if r["net_id"] == k]) for k in fixtures.REDUCIBLE)}
    result = size(stages["result"])
    assert size(stages["loops"])["idle_cycle"] == (0, 0)
    assert size(stages["sequences"])["chain"] == (2, 1) and result["live_cycle"] == (2, 2) and result["locks"] == (11, 6)
    assert result["resource_chain"][0] >= 3
    chain = [r for r in stages["result"].transitions.collect() if r["net_id"] == "chain"]
    assert chain[0]["orig_ids"] == [0, 1, 2]
    g = explore.explore(stages["result"])
    locks = {r["net_id"]: r for r in g.stats().collect()}["locks"]
    assert (locks["states"], locks["edges"]) == (11, 12)
    assert [r["marking"] for r in detect.deadlocks(g).where("net_id = 'locks'").collect()] == ["a1:1,b1:1,main_wait:1"]


def test_boundedness_and_invariants(spark):
    net = fixtures.net(spark, fixtures.GENERATOR | {"N2": fixtures.NETS["N2"]})
    got = {(r["net_id"], r["place_id"]): r for r in boundness.boundedness(net).collect()}
    assert got["N3", 1]["verdict"] == "Unbounded" and got["N3", 1]["witness"] == [0] and got["N3", 0]["verdict"] == "Bounded"
    assert got["N2", 0]["verdict"] == "Bounded" and got["N2", 0]["bound"] == 1
    assert boundness.boundedness(net, limit=0).where("verdict = 'Unknown'").count() > 0
    inv = {(r["kind"], r["vector"]) for r in boundness.invariants(net).where("net_id = 'N2'").collect()}
    assert inv == {("place", "0:1,1:1"), ("transition", "0:1,1:1")}


def test_whole_analysis(spark):
    net = fixtures.net(spark, {"N7": fixtures.NETS["N7"], "N5": fixtures.NETS["N5"]})
    out = analyse(net, "all")
    assert out["deadlocks"].count() == 1 and out["races"].count() == 1
    assert set(analyse(net, until="net")) == {"diagnosis"}
    with pytest.raises(ValueError):
        analyse(net, "none")
