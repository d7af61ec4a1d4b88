"""Known states by hash, sleep sets, components and calls, against plain versions in one process."""

import random
from math import gcd

import pytest
from pyspark.sql import functions as F

from petrelspark.operators import antichain, boundness, collect, cycles, detect, elimination, explore, pointsto, sleep, statestore, summaries, translate
from petrelspark.plans import fixtures, programs

from test_nets import by_net, random_nets


def test_runs_of_states(spark, monkeypatch):
    monkeypatch.setattr(statestore, "FOLDER_ROWS", 8)
    monkeypatch.setattr(statestore, "RUNS", 3)
    store = statestore.StateStore(spark)
    marking = F.array(F.col("id"), F.col("id") % 3)
    for k in range(9):
        rows = spark.range(20 * k, 20 * k + 20).select(F.lit("n").alias("net_id"), F.col("id").alias("state_id"), F.lit(k).alias("level"), marking.alias("marking"))
        store.add(rows.select("*", *statestore.hashed(F.col("net_id"), F.col("marking"))), 20)
    assert len(store.runs) < 9 and max(r.folders for r in store.runs) > 1 and store.every().count() == 180
    sought = spark.range(5, 190, 37).select(F.lit("n").alias("net_id"), marking.alias("marking")).select("*", *statestore.hashed(F.col("net_id"), F.col("marking")))
    found = sought.join(store.near(sought), statestore.SOUGHT).select("state_id").collect()
    assert sorted(r[0] for r in found) == [5, 42, 79, 116, 153] and store.near(sought).count() < 180


def test_large_frontiers_are_numbered_in_blocks(spark, monkeypatch):
    net = fixtures.net(spark, random_nets(5, n=3))
    want = explore.explore(net).states.select("net_id", "state_id", "marking").collect()
    monkeypatch.setattr(explore, "WHOLE", 0)
    monkeypatch.setattr(explore, "BLOCK", 2)
    assert sorted(map(str, explore.explore(net).states.select("net_id", "state_id", "marking").collect())) == sorted(map(str, want))


def test_sleep_sets_lose_no_state(spark):
    nets = random_nets(23, n=10, capacity=2) | {"N7": fixtures.NETS["N7"], "N11": fixtures.NETS["N11"], "free": (["p0:1/-", "p1:0/-", "q0:1/-", "q1:0/-", "r0:1/-", "r1:0/-"], ["a: p0 -> p1", "b: q0 -> q1", "c: r0 -> r1"])}
    net = fixtures.net(spark, nets)
    whole, less = explore.explore(net), sleep.explore_asleep(net)
    states = lambda g: {(r["net_id"], tuple(r["marking"]), tuple(r["enabled"])) for r in g.states.collect()}
    assert states(whole) == states(less) and less.states.count() == len(states(less))
    named = lambda g: {k: {(tuple(m[s]), t, tuple(m[d])) for s, t, d in e} for k, e in by_net(g.edges.collect(), "src", "trans_id", "dst").items() for m in [dict(by_net(g.states.collect(), "state_id", "marking")[k])]}
    all_, some = named(whole), named(less)
    assert all(some[k] <= all_[k] for k in some) and len(some["free"]) == 7 < len(all_["free"]) == 12 and sum(map(len, some.values())) < sum(map(len, all_.values()))
    dead = lambda g: {(r["net_id"], r["marking"]) for r in detect.deadlocks(g).collect()}
    assert {d for d in dead(whole) if d[0] in ("N7", "N11", "free")} == {d for d in dead(less) if d[0] in ("N7", "N11", "free")}


def components(edges):
    far = {}
    for key, a, b in edges:
        far.setdefault((key, a), {a}).add(b)
        far.setdefault((key, b), {b})
    changed = True
    while changed:
        changed = False
        for (key, _), s in far.items():
            more = set().union(*[far[key, x] for x in s])
            if not more <= s:
                s |= more
                changed = True
    return {(key, a): min(b for b in s if a in far[key, b]) for (key, a), s in far.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.choice("xy"), r.randrange(30), r.randrange(30)) for _ in range(r.choice([25, 45, 70]))] + [("z", k, (k + 1) % 17) for k in range(17)] + [("w", k, k + 1) for k in range(9)] + [("v", 3, 3)]
    d = spark.createDataFrame(edges + [("x", None, 1), edges[0]], "g string, src int, dst int")
    got = {(r["g"], r["node"]): r["component"] for r in cycles.strong_components(d, ["g"]).collect()}
    assert got == components(edges)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src int, dst int")
    nodes = spark.createDataFrame([(4,)], "node int")
    assert cycles.strong_components(none).count() == 0 and [tuple(r) for r in cycles.strong_components(none, nodes=nodes).collect()] == [(4, 4)]


def test_cycles_of_state_graphs(spark):
    g = explore.explore(fixtures.net(spark, fixtures.SPINNING))
    got = {(r["net_id"], r["component"], r["states"], r["closed"], tuple(r["blocked"])) for r in cycles.cycles(g).collect()}
    assert ("spin", 0, 2, True, (2,)) in got and {x[0] for x in got} == {"spin", "two_sets", "freed"}
    closed = {(r["net_id"], r["set"]) for r in detect.closed_sets(g).collect()}
    assert len(closed) == len({x for x in got if x[3]})


TYPES = "net_id string, func string, local string, ty string"
SITES = "net_id string, func string, bb int, target int, name string, args array<string>, dest string, span string"


def test_locks_by_destination(spark):
    guard = "std::sync::MutexGuard<'_, i32>"
    local = spark.createDataFrame([("p", "main", "_2", f"std::result::Result<{guard}, std::sync::PoisonError<{guard}>>"), ("p", "main", "_3", guard), ("p", "main", "_5", guard), ("p", "main", "_6", guard), ("p", "main", "_8", guard)], TYPES)
    sites = spark.createDataFrame([
        ("p", "main", 0, 1, "std::sync::Mutex::<i32>::lock", ["copy _1"], "_2", "0"), ("p", "main", 1, 2, "std::result::Result::<T, E>::unwrap", ["move _2"], "_3", "1"),
        ("p", "main", 2, 3, "std::sync::Condvar::wait", ["copy _7", "move _3"], "_4", "2"), ("p", "main", 3, 4, "std::result::Result::<T, E>::unwrap", ["move _4"], "_5", "3"),
        ("p", "main", 4, 5, "std::convert::identity", ["move _5"], "_6", "4"), ("p", "main", 5, 6, "std::mem::drop", ["move _6"], "_9", "5"), ("p", "main", 6, 7, None, ["copy _1"], "_8", "6"),
        ("p", "main", 7, None, "std::process::exit", ["const 1"], None, "7"), ("p", "main", 8, 9, "app::helper", [], "_10", "8"), ("p", "main", 10, 11, "app::other", [], "_11", "9"),
    ], SITES)
    owners = spark.createDataFrame([("p", "main", x, "A") for x in ("_3", "_5", "_6", "_8")] + [("p", "main", "_7", "C")], "net_id string, func string, local string, res string")
    functions = spark.createDataFrame([("p", "main"), ("p", "app::helper")], "net_id string, func string")
    blocks = spark.createDataFrame([("p", "main", 9, True), ("p", "main", 11, False)], "net_id string, func string, bb int, is_cleanup boolean")
    got = {r["bb"]: (r["action"], r["res"]) for r in collect.dispatched(sites, local, owners, functions, blocks=blocks).collect()}
    assert got == {0: ("plain", None), 1: ("mutex_lock", "A"), 2: ("wait", "C"), 3: ("plain", None), 4: ("plain", None), 5: ("unlock_mutex", "A"), 6: ("mutex_lock", "A"), 7: ("panic", None), 8: ("panic", None), 10: ("plain", None)}
    compat = {r["bb"]: r["action"] for r in collect.dispatched(sites, local, owners, functions, semantics="compat").collect()}
    assert compat[3] == compat[4] == "mutex_lock" and compat[8] == "normal"


def test_calls_that_never_return(spark):
    bodies = {"exits": ([], {"main": ["plain", "return"]}), "locks": (["A mutex"], {"main": ["mutex_lock A", "plain", "return"]})}
    functions, blocks, calls, resources = programs.facts(spark, bodies)
    calls = calls.withColumn("target", F.when(F.col("action") != "plain", F.col("target")))
    g = explore.explore(translate.translate(functions, blocks, calls, resources))
    assert detect.deadlocks(g).count() == 0 and g.terminal().count() == 2


def tree(net, limit=4000):
    """Karp and Miller, with all ancestors: the maximal ω-markings."""
    places, trans, arcs = fixtures.rows({"x": net})
    n, top = len(places), float("inf")
    pre, post = ([[0] * n for _ in trans] for _ in range(2))
    for _, p, t, way, w in arcs:
        (pre if way == "in" else post)[t][p] += w
    found, stack = set(), [((tuple(p[3] for p in places),), )]
    while stack:
        (line,) = stack.pop()
        m = line[-1]
        found.add(m)
        if m in line[:-1] or len(found) > limit:
            continue
        for t in range(len(trans)):
            if all(x >= y for x, y in zip(m, pre[t], strict=True)):
                after = [x - a + b for x, a, b in zip(m, pre[t], post[t], strict=True)]
                for a in line:
                    if all(x >= y for x, y in zip(after, a, strict=True)) and tuple(after) != a:
                        after = [top if x > y else x for x, y in zip(after, a, strict=True)]
                stack.append(((*line, tuple(after)),))
    return {m for m in found if not any(m != o and all(x <= y for x, y in zip(m, o, strict=True)) for o in found)}


def test_maximal_markings(spark):
    r = random.Random(4)
    nets = {}
    for k in range(8):
        names = [f"p{i}" for i in range(r.randrange(2, 5))]
        side = lambda: " + ".join(f"{r.choice([1, 1, 2])}*{p}" for p in r.sample(names, r.randrange(1, min(2, len(names)) + 1)))  # noqa: E731, B023
        nets[f"r{k}"] = ([f"{p}:{r.randrange(0, 3)}/-" for p in names], [f"t{i}: {side()} -> {side()}" for i in range(r.randrange(1, 4))])
    nets |= fixtures.GENERATOR | {"N2": fixtures.NETS["N2"], "N7": fixtures.NETS["N7"]}
    got = by_net(antichain.minimal_coverability(fixtures.net(spark, nets)).where("maximal and not cut").collect(), "marking")
    for k, net in nets.items():
        assert {tuple(float("inf") if x is None else x for x in m) for m, in got[k]} == tree(net), k
    few = fixtures.net(spark, {k: nets[k] for k in ("N2", "N3", "N7")})
    verdicts = {(r["net_id"], r["place_id"]): (r["verdict"], r["bound"]) for r in antichain.bounds(few).collect()}
    assert verdicts == {(r["net_id"], r["place_id"]): (r["verdict"], r["bound"]) for r in boundness.boundedness(few).collect()}
    assert antichain.bounds(few, limit=0).where("verdict = 'Unknown'").count() > 0


def plain_farkas(matrix):
    """Least-support combinations of rows, none negative, that make every column zero."""
    rows = [(list(r), [int(i == k) for i in range(len(matrix))]) for k, r in enumerate(matrix)]
    for c in range(len(matrix[0]) if matrix else 0):
        up, down = [r for r in rows if r[0][c] > 0], [r for r in rows if r[0][c] < 0]
        rows = [r for r in rows if r[0][c] == 0] + [tuple([-d[0][c] * x + u[0][c] * y for x, y in zip(u[k], d[k], strict=True)] for k in (0, 1)) for u in up for d in down]
    out = set()
    for _, own in rows:
        g = gcd(*own)
        out.add(tuple(x // g for x in own))
    return {o for o in out if not any(p != o and {i for i, x in enumerate(p) if x} < {i for i, x in enumerate(o) if x} for p in out)}


def incidence(net):
    places, trans, arcs = fixtures.rows({"x": net})
    c = [[0] * len(trans) for _ in places]
    for _, p, t, way, w in arcs:
        c[p][t] += w if way == "out" else -w if way == "in" else 0
    return c


def test_invariants_by_joins(spark):
    nets = random_nets(31, n=8) | {k: fixtures.NETS[k] for k in ("N2", "N7", "N10", "N5")} | fixtures.GENERATOR
    net = fixtures.net(spark, nets)
    for kind in ("place", "transition"):
        found = by_net(elimination.null_spaces(net, kind).collect(), "own")
        for k, n in nets.items():
            c = incidence(n)
            c = c if kind == "place" else [list(x) for x in zip(*c, strict=True)]
            want = boundness.null_space([list(x) for x in zip(*c, strict=True)], len(c))
            got = [[own.get(i, 0) for i in range(len(c))] for own, in found.get(k, [])]
            assert len(got) == len(want) and all(sum(x * r[j] for x, r in zip(v, c, strict=True)) == 0 for v in got for j in range(len(c[0])))
            rank = len(got) - len(boundness.null_space([list(x) for x in zip(*got, strict=True)], len(got))) if got else 0
            assert rank == len(got), (k, kind)
    least = by_net(elimination.semi_positive(net).where("not cut").collect(), "own")
    for k, n in nets.items():
        assert {tuple(own.get(i, 0) for i in range(len(n[0]))) for own, in least.get(k, [])} == plain_farkas(incidence(n)), k
    assert elimination.semi_positive(net, limit=0).where("cut").count() > 0
    bounds = {(r["net_id"], r["place_id"]): r["bound"] for r in elimination.covered(net).collect()}
    assert bounds["N7", 2] == 1 and ("N3", 1) not in bounds


def test_a_long_net_takes_few_rounds(spark, monkeypatch):
    n = 400
    long = {"long": ([f"p{k}:{int(k == 0)}/-" for k in range(n)], [f"t{k}: p{k} -> p{k + 1}" for k in range(n - 1)])}
    rounds, plain = [], elimination._taken
    monkeypatch.setattr(elimination, "_taken", lambda rows, step: rounds.append(step) or plain(rows, step))
    got = elimination.null_spaces(fixtures.net(spark, long)).collect()
    assert [dict(r["own"]) for r in got] == [{k: 1 for k in range(n)}] and len(rounds) < 40


def test_a_net_alone_and_among_others(spark):
    nets = random_nets(3, n=2) | {"N6": fixtures.NETS["N6"], "N7": fixtures.NETS["N7"]}
    two = fixtures.NETS["N6"][0] + ["q0:1/1", "q1:0/1"], fixtures.NETS["N6"][1] + ["go: q0 -> q1", "back: q1 -> q0"]
    nets["N6q"] = two
    search = lambda some, n: {(r["net_id"], *r[1:]) for r in detect.net_witnesses(explore.explore(fixtures.net(spark, some)), max_states=n).collect()}
    for n in (5, 9, 14):
        assert {x for x in search(nets, n) if x[0] == "N6q"} == search({"N6q": two}, n)
    assert search(nets, 10_000) == search(nets, None) and len(search({"N6q": two}, 5)) <= len(search({"N6q": two}, None))


def test_flow_summaries(spark):
    r = random.Random(8)
    names = [f"f{k}" for k in range(7)]
    copies = [(r.choice(names), f"_{r.randrange(5)}", f"_{r.randrange(5)}") for _ in range(14)] + [("f0", None, "_1")]
    calls = [(r.choice(names), r.choice(names), [f"_{r.randrange(5)}" if r.random() < 0.9 else None for _ in range(2)], f"_{r.randrange(5)}" if r.random() < 0.8 else None) for _ in range(9)]
    edges = {f: {(a, b) for g, a, b in copies if g == f and a and b} for f in names}
    found, changed = set(), True
    while changed:
        changed = False
        for f in names:
            for p in ("_1", "_2"):
                seen, todo = {p}, [p]
                while todo:
                    x = todo.pop()
                    for a, b in edges[f]:
                        if a == x and b not in seen:
                            seen.add(b)
                            todo.append(b)
                found |= {(f, p, g) for g in seen if g != p and g in ("_0", "_1", "_2")}
        for f, callee, args, dest in calls:
            spot = {"_0": dest, "_1": args[0], "_2": args[1]}
            for g, i, j in list(found):
                if g == callee and spot[i] and spot[j] and (spot[i], spot[j]) not in edges[f]:
                    edges[f].add((spot[i], spot[j]))
                    changed = True
    c = spark.createDataFrame(calls, "func string, callee string, args array<string>, dest string")
    got = summaries.summaries(spark.createDataFrame(copies, "func string, src string, dst string"), c, spark.createDataFrame([(f, p) for f in names for p in ("_1", "_2")], "func string, local string"))
    assert {tuple(x) for x in got.collect()} == found and found
    pairs = {(f, s[i], s[j]) for f, callee, args, dest in calls for s in [{"_0": dest, "_1": args[0], "_2": args[1]}] for g, i, j in found if g == callee and s[i] and s[j] and s[i] != s[j]}
    assert {tuple(x) for x in summaries.parameter_aliases(got, c).collect()} == pairs


def test_fields_while_solving(spark):
    rows = [("f", "a", "_1", "Address"), ("f", "_1.0", "x", "Copy"), ("f", "b", "p", "Address"), ("f", "_1.0.2", "p", "Store"), ("f", "b", "y", "Copy"), ("f", "_2.1", "z", "Copy"), ("f", "_1", "_2", "Copy")]
    pts = pointsto.points_to(spark.createDataFrame(rows, "func string, src string, dst string, kind string"), allocations=False, fields=True)
    got = {}
    for r in pts.collect():
        got.setdefault(r["node"], set()).add(r["target"])
    assert got == {"_1": {"a"}, "_1.0": {"a"}, "_1.0.2": {"a"}, "x": {"a"}, "p": {"b"}, "b": {"a"}, "y": {"a"}, "_2": {"a"}, "_2.1": {"a"}, "z": {"a"}}


def test_invariants_of_a_net_of_many_rows(spark):
    # each stage hands the tokens of its two places to the two of the next, so any choice of one place a stage is an invariant
    n = 10
    many = [f"{x}{k}:{int(k == 0) * (2 if x == 'a' else 3)}/-" for k in range(n) for x in "ab"], [f"t{k}: a{k} + b{k} -> a{k + 1} + b{k + 1}" for k in range(n - 1)]
    net = fixtures.net(spark, {"many": many, "N7": fixtures.NETS["N7"]})
    # before: a net of more than 1,000 rows on the way had no invariants and no bounds
    assert elimination.semi_positive(net).where("net_id = 'many'").count() == 2**n
    assert elimination.semi_positive(net, limit=1000).where("cut").select("net_id").collect() == [("many",)]
    bounds = {(r["net_id"], r["place_id"]): r["bound"] for r in elimination.covered(net).collect()}
    # the least bound of a place: by an invariant that has it and starts from the two tokens of a0
    assert {p: b for (of, p), b in bounds.items() if of == "many"} == {p: 3 if p == 1 else 2 for p in range(2 * n)} and bounds["N7", 2] == 1
