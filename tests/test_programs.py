"""Collectors, atomic segments, block chains, alias rules between functions, reports, and text documents."""

import os

import pytest
from pyspark.sql import functions as F

from petrelspark import queries
from petrelspark.operators import boundness, collect, detect, explore, translate
from petrelspark.plans import fixtures, programs, samples
from petrelspark.plans.net import Net
from petrelspark.sources import catalog, mir, sinks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_projections(spark):
    cases = [(["f1", "index[3]"], ["f1", "const[0]"], True), (["const[0]"], ["const[1]"], False), (["const[2]"], ["const[2]"], True), (["subslice[1..]"], ["const[0]"], True), (["f1"], ["f2"], False), (["f1"], ["f1", "f2"], False), ([], [], True), (["f1"], ["index[0]"], False)]
    d = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a array<string>, b array<string>")
    got = {r["k"]: r["m"] for r in d.select("k", collect.projections_may_meet(F.col("a"), F.col("b")).alias("m")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]
    p = spark.createDataFrame([("(*_1).0", False), ("_1.0", False), ("_1", True), ("const 3", False)], "p string, r boolean")
    assert [r[0] for r in p.select(collect.access_pattern(F.col("p"), F.col("r"))).collect()] == ["indirect", "direct", "ref", "constant"]
    n = spark.createDataFrame([("a::serialize_x",), ("a::run",)], "n string")
    assert [r[0] for r in n.select(collect.serialization(F.col("n"))).collect()] == [True, False]


def test_atomic_aliases_and_parameter_paths(spark):
    pts = spark.createDataFrame([("f", "_3", "_2"), ("f", "_4", "_2"), ("f", "_5", "Alloc(_6)"), ("f", "_7", "_1.0"), ("f", "_8", "_7.1")], "func string, node string, target string")
    pairs = spark.createDataFrame([("f", "_3", "_4"), ("f", "_3", "_5"), ("f", "_3", "_2"), ("f", "_2", "_2")], "func string, a string, b string")
    assert rows(collect.atomic_aliases(pts, pairs)) == [("f", "_2", "_2", "Probably"), ("f", "_3", "_2", "Probably"), ("f", "_3", "_4", "Unlikely"), ("f", "_3", "_5", "Unlikely")]
    nodes, params = spark.createDataFrame([("f", "_8"), ("f", "_5")], "func string, node string"), spark.createDataFrame([("f", "_1")], "func string, local string")
    assert rows(collect.parameter_paths(pts, nodes, params)) == [("f", "_8", ["_8:", "_7:1", "_1:0"])]
    edges = spark.createDataFrame([("p", "main", "work", "closure_def", "_2", None), ("p", "main", "work", "spawn", "bb0", "_3")], "net_id string, caller string, callee string, site_kind string, location string, dest string")
    assert rows(collect.closure_upvars(edges)) == [("p", "work", "main", "_2")]


def test_segments_and_chains(spark):
    spec = {"p": (["x atomic", "cell unsafe"], {"main": ["atomic_store x@Relaxed", "atomic_store x@Release", "atomic_load x@SeqCst", "return"]})}
    functions, blocks, calls, resources = programs.facts(spark, spec)
    base = translate.function_rows(functions).union(translate.block_rows(blocks)).union(translate.flow_rows(blocks)).union(translate.call_rows(calls)).union(translate.resource_rows(resources))
    net = translate.as_net(base.union(collect.segments(calls)))
    names = {r["name"]: r["tokens"] for r in net.places.collect()}
    assert {k: v for k, v in names.items() if k.startswith("seg") or k.startswith("Seq")} == {"seg_t0_s0": 1, "seg_t0_s1": 0, "seg_t0_s2": 0, "SeqCst_Global": 1}
    g = explore.explore(net)
    assert detect.deadlocks(g).count() == 0 and g.stats().first()["states"] == 6
    access = spark.createDataFrame([("p", "main", 0, 0, "unsafe_read", "cell", "a", 0), ("p", "main", 0, 1, "unsafe_write", "cell", "b", 0)], "net_id string, func string, bb int, seq int, action string, res string, span string, tid int")
    chain = collect.block_chain(access)
    assert [r["id"] for r in chain.where("kind = 'place'").orderBy("id").collect()] == ["main_bb0_1", "main_bb0_2"] and rows(collect.chain_end(access)) == [("p", "main", 0, "main_bb0_2")]
    assert {r["ttype"] for r in chain.where("kind = 'transition'").collect()} == {"UnsafeRead", "UnsafeWrite"}


def test_dispatched_program_runs(spark):
    """From types and call sites to a net with a deadlock."""
    locals_ = [("p", f, "_4", "std::sync::MutexGuard<'_, i32>") for f in ("main", "w")] + [("p", f, "_5", "std::sync::MutexGuard<'_, i32>") for f in ("main", "w")] + [("p", "main", "_2", "{closure@w}")]
    owners = [("p", "main", "_4", "A"), ("p", "main", "_5", "B"), ("p", "w", "_4", "B"), ("p", "w", "_5", "A")]
    lock = "std::sync::Mutex::<i32>::lock"
    body = [(lock, "_4"), (lock, "_5"), ("std::mem::drop", "move _5"), ("std::mem::drop", "move _4")]
    sites = [("p", "main", 0, 1, "std::thread::spawn", ["move _2"], "_9", "s")]
    for f, at in (("main", 1), ("w", 0)):
        sites += [("p", f, at + k, at + k + 1, name, [x] if name != lock else ["copy _1"], x if name == lock else "_8", "s") for k, (name, x) in enumerate(body)]
    blocks = [("p", f, k, False, False, "return" if k == last else "call", "", []) for f, last in (("main", 5), ("w", 4)) for k in range(last + 1)]
    functions = spark.createDataFrame([("p", "main", True), ("p", "w", False)], programs.FUNCTIONS)
    calls = collect.dispatched(spark.createDataFrame(sites, "net_id string, func string, bb int, target int, name string, args array<string>, dest string, span string"), spark.createDataFrame(locals_, "net_id string, func string, local string, ty string"), spark.createDataFrame(owners, "net_id string, func string, local string, res string"), functions)
    net = translate.translate(functions, spark.createDataFrame(blocks, programs.BLOCKS), calls, spark.createDataFrame([("p", "A", "mutex"), ("p", "B", "mutex")], programs.RESOURCES))
    assert [r["marking"] for r in detect.deadlocks(explore.explore(net)).collect()] == ["main_bb2:1,w_bb1:1"]


def test_limits_and_invariants_first(spark):
    g = explore.explore(fixtures.net(spark, {"N6": fixtures.NETS["N6"]}))
    every = detect.net_witnesses(g)
    assert detect.net_witnesses(g, max_depth=1).count() == 0 and detect.net_witnesses(g, max_states=1).count() == 0 and every.count() == 3
    record = detect.pattern_records(every, g.net.transitions).where("rule = 3").first()
    assert (record["data_type"], record["start_op"]["name"], record["mid_op"]["name"], record["mid_op"]["tid"]) == ("i32", "load", "store_b", 2)
    net = fixtures.net(spark, fixtures.GENERATOR | {"N7": fixtures.NETS["N7"]})
    got = {(r["net_id"], r["place_id"]): (r["verdict"], r["bound"]) for r in boundness.boundedness_with_invariants(net).collect()}
    want = {(r["net_id"], r["place_id"]): (r["verdict"], r["bound"]) for r in boundness.boundedness(net).collect()}
    assert got == want


def test_counts_without_pairs(spark):
    import random

    r = random.Random(4)
    acc = [(r.randrange(5), r.choice("xy"), r.randrange(3), r.random() < 0.4, k) for k in range(120)] + [(1, None, 1, True, 500), (1, "x", None, True, 501)]
    d = spark.createDataFrame(acc, "state int, location string, thread int, write boolean, ord int")
    want = detect.race_pairs(d, different_threads=True).groupBy("location").agg(F.count("*").alias("pairs"), F.countDistinct("state").alias("states"))
    assert rows(detect.race_counts(d)) == rows(want)


def test_closed_sets(spark):
    """Against a plain search on random graphs."""
    import random

    r = random.Random(6)
    for size in (4, 9):
        edges = [(r.randrange(size), r.randrange(size)) for _ in range(size + 2)]
        reach = {v: {v} for v in range(size)}
        for _ in range(size):
            for a, b in edges:
                for v in reach:
                    if a in reach[v]:
                        reach[v] |= {b}
        closed = {frozenset(reach[v]) for v in reach if all(reach[w] == reach[v] for w in reach[v])}
        closed = {s for s in closed if len(s) > 1 or any(a == b and a in s for a, b in edges)}
        states = spark.createDataFrame([("n", v, 0, [0], [0]) for v in range(size)], "net_id string, state_id long, level int, marking array<long>, enabled array<int>")
        graph = explore.StateGraph(Net.empty(spark), states, spark.createDataFrame([("n", a, 0, b) for a, b in edges], "net_id string, src long, trans_id int, dst long"), None, None)
        got = {}
        for x in detect.closed_sets(graph).collect():
            got.setdefault(x["set"], set()).add(x["state"])
        assert {frozenset(s) for s in got.values()} == closed


def test_reports_and_files(spark, tmp_path):
    g = explore.explore(fixtures.net(spark, {k: fixtures.NETS[k] for k in ("N5", "N6")}))
    races = detect.merged_races(detect.race_pairs(detect.accesses(g), ["net_id"]), ["net_id"])
    assert "location: 0" in sinks.race_report(races).first()["text"]
    assert sinks.atomicity_report(detect.atomicity(g)).first()["text"].endswith("stores: 10:5, 12:5")
    sinks.write_net(g.net, f"{tmp_path}/net")
    back = sinks.read_net(spark, f"{tmp_path}/net")
    assert all(rows(getattr(back, t)) == rows(getattr(g.net, t)) for t in ("places", "transitions", "arcs"))
    found = sinks.collected_json({"places": g.net.places.select("net_id", "name")})
    assert {r["json"] for r in found.collect()} == {'{"net_id":"N5","name":"shared"}', '{"net_id":"N6","name":"shared_atomic"}'}
    bench = catalog.bench_table(spark.createDataFrame([("deadlock", "c1", x, 1, 2, 9 - x, 8 - x, 7 - x) for x in (False, True)], "detector string, case string, reduced boolean, bug_count int, callable_functions int, places int, transitions int, states int"))
    assert sinks.bench_tex(bench).first()["tex"] == "deadlock & c1 & 1 & 2 & 9 & 8 & 7 & 8 & 7 & 6 \\\\"
    sinks.write_bench(bench, f"{tmp_path}/bench")
    assert spark.read.option("header", True).csv(f"{tmp_path}/bench").first()["raw_places"] == "9"


@pytest.mark.parametrize("name,column,parts", [
    ("mir_pnml", "xml", ['<place id="p_main_bb1">', '<transition id="t_main_bb0_to_bb1">', "<initialMarking><text>1</text></initialMarking>"]),
    ("net_dot", "dot", ["digraph net {", 'p0 [shape=circle, label="p0\\n(1)"];', "p0 -> t0;", "t0 -> p1;"]),
    ("state_graph_dot", "dot", ["digraph states {", 's0 -> s1 [label="t0"];', 's1 [label="p1:1", peripheries=2];']),
])
def test_text_documents(spark, name, column, parts):
    """The documents of one literal net or text, and of every order where the tables are there."""
    one = {
        "mir_pnml": lambda: sinks.pnml(mir.net_rows(spark.createDataFrame(samples.PROGRAMS, "path string, text string"))),
        "net_dot": lambda: sinks.net_dot(fixtures.net(spark)), "state_graph_dot": lambda: sinks.graph_dot(explore.explore(fixtures.net(spark, {"N1": fixtures.NETS["N1"]}))),
    }
    by = {r[0]: r[column] for r in one[name]().collect()}
    text = by["ledger.mir" if name == "mir_pnml" else "N1"]
    assert all(p in text for p in parts)
    if name != "state_graph_dot" and os.path.isdir(SF):
        every = queries.QUERIES[name](spark, SF)
        assert every.count() == spark.read.parquet(f"{SF}/orders.parquet").count() and every.where(~F.col(column).contains("main")).count() == 0


def test_command_line(spark, tmp_path):
    from petrelspark.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mir").write_text(samples.LEDGER)
    main([str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--settings", str(tmp_path / "none.toml")])
    stats = spark.read.json(f"{tmp_path}/out/stats").first()
    assert stats["deadlocks"] == 1 and spark.read.json(f"{tmp_path}/out/deadlocks").count() == 0
    main([f"{tmp_path}/out/net", "--net", "--until", "net", "--out", str(tmp_path / "again")])
    assert {p.name for p in (tmp_path / "again").iterdir()} == {"diagnosis", "net"}


def test_joins_closures_and_needed_functions(spark):
    local = spark.createDataFrame([("p", "main", "_2", "{closure@job}")], "net_id string, func string, local string, ty string")
    functions = spark.createDataFrame([("p", "main", True), ("p", "job", False), ("p", "idle", False), ("p", "locks", False)], programs.FUNCTIONS)
    sites = [("p", "main", 0, 1, "std::thread::spawn", ["move _2"], "_3", ""), ("p", "main", 1, 2, "std::thread::JoinHandle::join", ["move _5"], "_4", ""), ("p", "main", 2, 3, "core::ops::FnOnce::call_once", ["move _2"], "_6", "")]
    s = spark.createDataFrame(sites, "net_id string, func string, bb int, target int, name string, args array<string>, dest string, span string")
    handles = spark.createDataFrame([("p", "main", "_5", "job")], "net_id string, func string, local string, callee string")
    owners = spark.createDataFrame([], "net_id string, func string, local string, res string")
    assert [(r["action"], r["callee"]) for r in collect.dispatched(s, local, owners, functions, handles).orderBy("bb").collect()] == [("spawn", "job"), ("join", "job"), ("normal", "job")]
    edges = collect.call_sites(s, local, functions)
    assert rows(collect.needed(functions, edges)) == [("p", "job"), ("p", "main")]
    assert rows(collect.needed(functions, edges, functions.where("func = 'locks'"))) == [("p", "job"), ("p", "locks"), ("p", "main")]


def test_sleep_sets_and_crate_names(spark):
    from petrelspark.functions import markings as M
    from petrelspark.plans.settings import crate_name

    d = spark.createDataFrame([([1, 2, 3], [2, 4])], "a array<int>, b array<int>")
    assert d.select(M.asleep_after(F.col("a"), F.col("b")), M.asleep_in_both(F.col("a"), F.col("b")), M.asleep_with(F.col("a"), F.col("b"))).first()[:] == ([1, 3], [2], [1, 2, 3, 4])
    assert [crate_name(x) for x in (["rustc", "--crate-name", "app", "m.rs"], ["--crate-name=lib"], ["src/tool.rs"], [])] == ["app", "lib", "tool", None]
