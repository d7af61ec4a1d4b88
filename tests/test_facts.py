"""Traces, closures, points-to sets, names, translation, IR text, sinks and catalogs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from petrelspark.functions import classify as C
from petrelspark.operators import closure, detect, explore, pointsto, sequence, translate
from petrelspark.operators.components import connected_components
from petrelspark.operators.ordering import numbered
from petrelspark.plans import fixtures, samples
from petrelspark.plans.settings import Settings
from petrelspark.sources import catalog, mir, sinks

TRACES = {"L1 S2 S1": {(1, 1, 2, 1, 2, 3)}, "S1 S2 L1": {(2, 1, 2, 1, 2, 3)}, "L1 S2 L1": {(3, 1, 2, 1, 2, 3)}, "L1 S1 L1": set(), "L1 S2 S2 L1": {(3, 1, 2, 1, 3, 4)}, "L1 S2 S3 L1": {(3, 1, 2, 1, 2, 4), (3, 1, 3, 1, 3, 4)}, "L1 S2 S1 S1": {(1, 1, 2, 1, 2, 3)}, "S2 L1 L1": set()}


def automaton(events):
    out = set()
    for rule, (s, m, e) in sequence.RULES.items():
        start, seen = {}, {}
        for idx, tid, var, kind in events:
            me = (var, tid)
            if kind == e and me in start:
                out |= {(rule, tid, j, start[me], at, idx, var) for j, at in seen[me].items()}
                seen[me] = {}
            if kind == m:
                for (v, i), found in seen.items():
                    if v == var and i != tid:
                        found[tid] = idx
            if kind == s:
                start[me], seen[me] = idx, {}
    return out


def test_trace_fixtures(spark):
    rows = [(name, k + 1, int(x[1]), "v", "load" if x[0] == "L" else "store") for name in TRACES for k, x in enumerate(name.split())]
    got = {name: set() for name in TRACES}
    for r in sequence.witnesses(spark.createDataFrame(rows, "trace_id string, idx long, tid int, var string, kind string"), ["trace_id"]).collect():
        got[r["trace_id"]].add((r["rule"], r["tid_i"], r["tid_j"], r["start_idx"], r["mid_idx"], r["end_idx"]))
    assert got == TRACES


@pytest.mark.parametrize("width", [3, 64])
def test_random_traces(spark, width):
    r = random.Random(width)
    events = [(k, r.randrange(3), r.choice("xyz"), r.choice(["load", "store"])) for k in range(1, 300)]
    t = spark.createDataFrame([*events, (None, 1, "x", "load"), (500, 1, None, "load")], "idx long, tid int, var string, kind string")
    for found in (sequence.binned_witnesses(t, width), sequence.witnesses(t)):
        assert {(x["rule"], x["tid_i"], x["tid_j"], x["start_idx"], x["mid_idx"], x["end_idx"], x["var"]) for x in found.collect()} == automaton(events)


def test_numbering(spark):
    d = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "v long")
    assert [r["idx"] for r in numbered(d, ["v"]).orderBy("v").collect()] == list(range(1, 1001))


def test_components_and_closure(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)] + [(400, 400), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    e = spark.createDataFrame(edges, "a long, b long")
    assert {(x[0], x[1]) for x in connected_components(e).collect()} == {(n, find(n)) for n in parent}
    assert connected_components(e.where("false")).count() == 0
    paths = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4)], "src int, dst int")
    got = {(x["node"], x["depth"]) for x in closure.reachable(paths, spark.createDataFrame([(1, 1)], "root int, node int")).collect()}
    assert got == {(1, 0), (2, 1), (4, 1), (3, 2)}
    one = lambda n: spark.createDataFrame([(n,)], "node int")
    assert sorted(x["path"] for x in closure.simple_paths(paths, one(1), one(4)).collect()) == [[1, 2, 3, 4], [1, 4]]


def test_points_to(spark):
    rows = [("f", "a", "x", "Address"), ("f", "x", "y", "Copy"), ("f", "y", "z", "Load"), ("f", "w", "y", "Store"), ("f", None, "y", "Copy")]
    pts = pointsto.points_to(spark.createDataFrame(rows, "func string, src string, dst string, kind string"))
    got = {}
    for r in pts.collect():
        got.setdefault(r["node"], set()).add(r["target"])
    A = "Alloc({})".format  # noqa: N806
    assert got == {"x": {A("x"), "a"}, "y": {A("y"), A("x"), "a"}, "a": {A("a"), A("w")}, "w": {A("w")}, "z": {A("z"), A("a"), A("w")}}
    pairs = spark.createDataFrame([("f", "x", "y"), ("f", "z", "w"), ("f", "x", "z"), ("f", "x", "missing")], "func string, a string, b string")
    kinds = {(r["a"], r["b"]): r["kind"] for r in pointsto.aliases(pts, pairs).collect()}
    assert kinds == {("x", "y"): "Probably", ("z", "w"): "Probably", ("x", "z"): "Unlikely", ("x", "missing"): "Unknown"}
    assert pointsto.all_alias_links(pts).count() > 0 and pointsto.report(pts).first()["node"] == "a"


def test_points_to_of_every_order(spark, tmp_path):
    from petrelspark import queries

    orders = [(k, (k * k + 3) % 7, "FOP"[k % 3], ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")[k % 5]) for k in range(1, 24)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    rows = {(f"a{k}" if s == "F" else f"v{c}", f"v{c}" if s == "F" else f"v{k}", s) for k, c, s, _ in orders}
    odd = {(f"v{c}", f"v{k}") for k, c, s, _ in orders if s == "P" and k % 2}
    pts = {n: {f"Alloc({n})"} for r in rows for n in r[:2]}
    before = None
    while before != pts:
        before = {n: set(t) for n, t in pts.items()}
        for src, dst, s in rows:
            if s == "F":
                pts[dst].add(src)
            elif s == "O":
                pts[dst] |= pts[src]
            elif (src, dst) in odd:
                for place in [x for x in pts[dst] if x in pts]:
                    pts[place] |= pts[src]
            else:
                for place in [x for x in pts[src] if x in pts]:
                    pts[dst] |= pts[place]
    assert {tuple(r) for r in queries.points_to_full(spark, str(tmp_path)).collect()} == {(n, x) for n, t in pts.items() for x in t}


def test_names(spark):
    d = spark.createDataFrame([("std::thread::spawn",), ("tokio::task::spawn",), ("rayon::join",), ("app::run",)], "n string")
    assert [r[0] for r in d.select(C.thread_control(F.col("n"))).collect()] == ["spawn", "async_spawn", "rayon_join", None]
    assert [r[0] for r in d.select(C.thread_control(F.col("n"), {"join": F.col("n") == "app::run"})).collect()][3] == "join"
    o = spark.createDataFrame([(x,) for x in (-1, 0, 4, 9)], "c int")
    assert [r[0] for r in o.select(C.memory_ordering(F.col("c"))).collect()] == ["SeqCst", "Relaxed", "SeqCst", "SeqCst"]
    assert detect.compatible(F.lit("Relaxed"), F.lit("Release")) is not None
    assert d.where(F.lit("x").rlike(C.any_of([]))).count() == 0


def facts(spark, order):
    """A program of two threads that lock two mutexes; ``order``: of the second one."""
    F1 = "net_id string, func string, is_entry boolean"  # noqa: N806
    functions = spark.createDataFrame([("p", "main", True), ("p", "t1", False), ("p", "t2", False)], F1)
    blocks, calls = [], []

    def body(func, steps):
        for k, (action, more) in enumerate(steps):
            last = action == "return"
            blocks.append(("p", func, k, False, False, "return" if last else "call", "", []))
            if not last:
                calls.append(("p", func, k, k + 1, action, more if action in ("spawn", "join") else None, None, None if action in ("spawn", "join") else more, None, None, "", 0))

    body("main", [("spawn", "t1"), ("spawn", "t2"), ("join", "t1"), ("join", "t2"), ("return", None)])
    body("t1", [("mutex_lock", "A"), ("mutex_lock", "B"), ("unlock_mutex", "B"), ("unlock_mutex", "A"), ("return", None)])
    body("t2", [("mutex_lock", order[0]), ("mutex_lock", order[1]), ("unlock_mutex", order[1]), ("unlock_mutex", order[0]), ("return", None)])
    b = spark.createDataFrame(blocks, "net_id string, func string, bb int, is_cleanup boolean, is_empty_unreachable boolean, term_kind string, span string, targets array<int>")
    c = spark.createDataFrame(calls, "net_id string, func string, bb int, target int, action string, callee string, callees array<string>, res string, res2 string, ordering string, span string, tid int")
    return functions, b, c, spark.createDataFrame([("p", "A", "mutex"), ("p", "B", "mutex")], "net_id string, res string, kind string")


@pytest.mark.parametrize("order,found", [("BA", 1), ("AB", 0)])
def test_translated_program(spark, order, found):
    net = translate.translate(*facts(spark, order))
    assert net.transitions.where("ttype = 'Lock'").count() == 4
    assert detect.deadlocks(explore.explore(net)).count() == found


def test_tasks_and_flow(spark):
    tasks = spark.createDataFrame([("p", "job", 1)], "net_id string, task string, awaits int")
    net = translate.as_net(translate.task_rows(tasks))
    assert {r["name"] for r in net.places.collect()} >= {"job_ready", "job_running", "job_completed", "async_worker", "job_blocked1"}
    assert net.transitions.count() == 5
    ends = spark.createDataFrame([("p", "f", k, False, False, "return", "", []) for k in range(2)], "net_id string, func string, bb int, is_cleanup boolean, is_empty_unreachable boolean, term_kind string, span string, targets array<int>")
    assert translate.flow_rows(ends).where("kind = 'transition'").select("id").distinct().count() == 2
    assert translate.flow_rows(ends, "compat").where("kind = 'transition'").select("id").distinct().count() == 1


def test_pairs_and_groups(spark):
    e = spark.createDataFrame([(1, 10, "sender"), (1, 11, "receiver"), (2, 12, "sender"), (3, 13, "sender"), (3, 14, "sender")], "site int, endpoint int, role string")
    assert [tuple(r) for r in translate.channel_pairs(e).collect()] == [(1, 10, 11)]
    links, guards = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), spark.createDataFrame([(1, "rwlock"), (2, "mutex"), (3, "mutex"), (9, "mutex")], "guard long, kind string")
    assert {tuple(r) for r in translate.lock_groups(links, guards).collect()} == {(1, "rwlock", 3, 10), (9, "mutex", 1, 1)}
    moves = spark.createDataFrame([("f", 1, 2), ("f", 2, 3)], "func string, src int, dst int")
    assert {r["local"] for r in translate.handle_flow(moves, spark.createDataFrame([("f", 1, 7)], "func string, local int, callee int")).collect()} == {1, 2, 3}


def count(rows, path):
    return {k: sum(r["path"] == path for r in d.collect()) for k, d in rows.items()}


def test_ir_text(spark):
    t = spark.createDataFrame(samples.PROGRAMS, "path string, text string")
    rows = mir.net_rows(t)
    assert count(rows, "ledger.mir") == {"places": 8, "transitions": 5, "arcs": 14, "warnings": 1}
    kinds = sorted((r["kind"], r["op"]) for r in rows["transitions"].where("path = 'ledger.mir' and kind != 'cfg'").collect())
    assert kinds == [("lock", "_2"), ("unlock", "_2")]
    counter = mir.net_rows(t)["transitions"].where("path = 'counter.mir' and kind = 'unlock'").collect()
    assert [r["op"] for r in counter] == ["_1"]
    compat = {(r["basic_block"], r["reason"]) for r in mir.net_rows(t, semantics="compat")["warnings"].where("function = 'main'").collect()}
    assert ("bb0", "no terminator found") in compat
    assert mir.net_rows(t, max_fns=1)["places"].where("path = 'counter.mir' and name = 'main_entry'").count() == 0
    xml = {r["path"]: r["xml"] for r in sinks.pnml(rows).collect()}["ledger.mir"]
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(xml)
    assert xml.count("<initialMarking>") == 2 and "inscription" not in xml and len(tree.findall(".//{*}place")) == 8
    doc = json.loads({r["path"]: r["json"] for r in sinks.net_json(rows).collect()}["ledger.mir"])
    assert set(doc) >= {"places", "transitions", "arcs", "initial_marking"} and len(doc["initial_marking"]) == 2
    assert mir.net_rows(t.where("false"))["places"].count() == 0


def test_dot_and_catalog(spark, tmp_path):
    net = fixtures.net(spark, {"N1": fixtures.NETS["N1"]})
    dot = sinks.net_dot(net).first()["dot"]
    assert "p0 -> t0;" in dot and "t0 -> p1;" in dot
    g = explore.explore(net)
    states = sinks.graph_dot(g).first()["dot"]
    run = tmp_path / "a" / "run1"
    run.mkdir(parents=True)
    (run / "stategraph.dot").write_text(states)
    (run / "summary.json").write_text("{}")
    (tmp_path / "a" / "case.rs").write_text("fn main() {}")
    found = catalog.runs(spark, str(tmp_path))
    assert [r["kinds"] for r in found.collect()] == [["stategraph", "summary"]] and catalog.cases(spark, str(tmp_path)).count() == 1
    assert catalog.artifact(found, "summary").first()["path"].endswith("run1/summary.json")
    counts = catalog.dot_counts(spark, str(tmp_path)).first()
    assert (counts["nodes"], counts["edges"]) == (2, 1)
    sinks.write_report(sinks.summary(g, detect.deadlocks(g)), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["states"] == 2
    assert "f1 -> f2" in sinks.call_dot(spark.createDataFrame([(1, 2)], "caller int, callee int")).first()["dot"]
    st = spark.createDataFrame([("f", 0, k, f"s{k}") for k in range(5)], "func string, bb int, seq int, text string")
    bl = spark.createDataFrame([("f", 0, [1]), ("f", 1, [])], "func string, bb int, targets array<int>")
    cfg = sinks.cfg_dot(st, bl).first()["dot"]
    assert "s2" in cfg and "s3" not in cfg and "..." in cfg


def test_settings(tmp_path):
    assert Settings.load(str(tmp_path / "none.toml")) == Settings()
    (tmp_path / "x.toml").write_text("state_limit = 0\npor = true\n")
    s = Settings.load(str(tmp_path / "x.toml"))
    assert s.limit is None and s.por
    (tmp_path / "x.toml").write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "x.toml"))


def test_staging(spark):
    import os

    from petrelspark.staging import session_dir, stage, sweep

    d = stage(spark.range(3).toDF("x"), "kept")
    assert sorted(r["x"] for r in d.collect()) == [0, 1, 2]
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session_dir(spark).startswith(named.rstrip("/") if named else "file:///")
    folder = session_dir(spark).removeprefix("file://")
    assert any(n.startswith("kept-") for n in os.listdir(folder))
    sweep(spark)
    assert not os.path.exists(folder)


def test_programs_alike_are_translated_once(spark, monkeypatch):
    made = []
    plain = translate.as_net
    monkeypatch.setattr(translate, "as_net", lambda rows: made.append({r[0] for r in rows.select("net_id").distinct().collect()}) or plain(rows))
    one = facts(spark, "BA")
    named = lambda d, *names: d.drop("net_id").crossJoin(spark.createDataFrame([(n,) for n in names], "net_id string")).select(d.columns)
    many = [named(d, "a", "b", "c", "d", "e") for d in one]
    # one call more, twice as many of one, and a value that moves to the column beside it
    call = many[2].where("func = 't1' and bb = 0")
    many[2] = many[2].where("net_id != 'e' or func != 't1' or bb != 0").union(call.where("net_id = 'c'")).union(call.where("net_id = 'e'").withColumns({"res": F.lit(None).cast("string"), "res2": F.col("res")}))
    many[3] = many[3].union(spark.createDataFrame([("d", "B", "mutex")], "net_id string, res string, kind string"))
    once, each = translate.translate_once(*many), translate.translate(*many)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(once.places) == rows(each.places) and rows(once.transitions) == rows(each.transitions) and rows(once.weights()) == rows(each.weights()) and once.places.columns == each.places.columns
    assert made[0] == {"a", "c", "d", "e"} and made[1] == {"a", "b", "c", "d", "e"}
    assert {tuple(r) for r in translate.alike(*many).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")}


@pytest.mark.parametrize("width", [4, 64, 4096])
def test_slices_are_cut_from_bins(spark, width):
    r = random.Random(5)
    events = [(k, r.randrange(3), r.choice("xy"), r.choice(["load", "store"])) for k in range(1, 150) if k % 11]
    found = [(v, a, a + n) for v in "xyz" for a, n in [(1, 0), (3, 5), (11, 22), (11, 22), (20, 100), (70, 1), (149, 40)]]
    want = sorted((v, a, b, s) for v, a, b in found if (s := [f"{k}:{t}:{what}" for k, t, x, what in events if x == v and a <= k <= b]))
    d = sequence.slices(spark.createDataFrame(events, "idx long, tid int, var string, kind string").repartition(3), spark.createDataFrame(found, "var string, start_idx long, end_idx long"), width)
    assert sorted(tuple(x) for x in d.collect()) == want
