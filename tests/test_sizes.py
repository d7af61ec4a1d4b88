"""Plans of joins over staged tables, whose files are far smaller than their rows."""

from petrelspark.plans import order_nets
from petrelspark.staging import FEW, counted


def test_firing_broadcasts_no_net(spark):
    firing = order_nets.nets(spark, "/root/testdata/sf0.01").firing()
    plan = firing._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


def test_few_rows_are_broadcast(spark):
    many, few = (counted(spark.range(n).selectExpr("id", "repeat('x', 50) as text")) for n in (4 * FEW, 10))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(many.join(many.withColumnRenamed("text", "other"), "id"))
    assert "BroadcastExchange" in plan(many.join(few.withColumnRenamed("text", "other"), "id"))
    assert counted(spark.range(0)).count() == 0


def test_lines_of_text_are_ordered_once(spark):
    from petrelspark.sources import mir

    texts = spark.createDataFrame([("a", "fn f() -> () {\n    bb0: {\n        return;\n    }\n}"), ("b", "")], "path string, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    rows = mir.lines(texts)
    # before: six windows in the plan, and the form of a terminator spelt out for each place that reads a part of it
    assert plan(rows).count("Window [") == 1
    assert len(plan(mir.blocks(rows))) < 60_000
    assert [(r["path"], r["fn"], r["bb"], r["kind"]) for r in mir.blocks(rows).collect()] == [("a", "f", 0, "return")]


def test_nets_with_one_matrix_are_solved_once(spark):
    from pyspark.sql import functions as F

    from petrelspark.operators import boundness, elimination
    from petrelspark.plans import fixtures

    net = fixtures.net(spark, {"A": fixtures.NETS["N7"], "B": fixtures.NETS["N7"], "C": fixtures.NETS["N2"]})
    seen = []

    def solve(shapes):
        seen.append(shapes.count())
        return shapes.select(F.col("of").alias("net_id"), F.size("shape.cells").alias("n"))

    rows = {r["net_id"]: r["n"] for r in elimination.by_shape(net, solve).collect()}
    # before: a net was solved for itself, however many were alike
    assert seen == [2] and rows["A"] == rows["B"] > rows["C"] == 4
    of = lambda d, *c: {n: sorted(str([r[x] for x in c]) for r in d.where(f"net_id = '{n}'").collect()) for n in "ABC"}
    for found in (of(boundness.invariants(net), "kind", "number", "vector"), of(elimination.null_spaces(net), "number", "own")):
        assert found["A"] == found["B"] and found["A"] and found["C"] and found["A"] != found["C"]


def test_nets_deal_line_items_once(spark):
    net = order_nets.nets(spark, "/root/testdata/sf0.001", staged=False)
    for rows in (net.weights(), net.incidence(), net.initial()):
        # before: windows by order and by net, sizes, joins of threads and steps and the sums of arcs each dealt the rows anew
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_nets_that_are_alike_are_explored_once(spark):
    from pyspark.sql import functions as F

    from petrelspark.operators import detect, explore, likes
    from petrelspark.plans import fixtures

    net = fixtures.net(spark, {"A": fixtures.NETS["N7"], "B": fixtures.NETS["N7"], "C": fixtures.NETS["N2"]})
    seen = []

    def solve(part):
        seen.extend(sorted(r[0] for r in part.places.select("net_id").distinct().collect()))
        return detect.deadlocks(explore.explore(part, 20)).select("net_id", "state_id", "marking")

    rows = lambda d: sorted(map(tuple, d.collect()))
    got = likes.once(net, solve, ["name", "place_type"])
    assert seen == ["A", "C"]  # before: each net by itself
    assert rows(got) == rows(detect.deadlocks(explore.explore(net, 20)).select("net_id", "state_id", "marking"))
    shared, own = likes.explore_once(net, 20), explore.explore(net, 20)
    assert rows(shared.edges) == rows(own.edges) and rows(shared.stats()) == rows(own.stats())
    # nets that differ in a name are of two kinds only where the name is read
    other = explore.Net(net.places.withColumn("name", F.concat("name", F.when(F.col("net_id") == "B", "x").otherwise(""))), net.transitions, net.arcs)
    kinds = lambda *names: likes.likes(other, names).nets.select("like").distinct().count()
    assert (kinds(), kinds("name")) == (2, 3)


def test_small_functions_take_no_rounds(spark, monkeypatch):
    import random

    from petrelspark.operators import pointsto, summaries

    draw = random.Random(27)
    node = lambda: draw.choice("abcdef")
    rows = [(f"f{draw.randrange(6)}", node(), node(), draw.choice(["Address", "Copy", "Load", "Store"])) for _ in range(60)] + [("f0", None, "a", "Copy"), (None, "a", "b", "Address")]
    c = spark.createDataFrame(rows, "func string, src string, dst string, kind string")
    local = lambda: f"_{draw.randrange(4)}"
    copies = spark.createDataFrame([(f"f{draw.randrange(6)}", local(), local()) for _ in range(15)], "func string, src string, dst string")
    calls = spark.createDataFrame([(f"f{draw.randrange(6)}", f"f{draw.randrange(7)}", [local(), draw.choice([None, local()])], local()) for _ in range(12)], "func string, callee string, args array<string>, dest string")
    own = spark.createDataFrame([(f"f{k}", p) for k in range(6) for p in ("_1", "_2")], "func string, local string")
    all_ = lambda d: sorted(map(tuple, d.collect()))
    # functions of 10 constraints or more go by rounds, then all, then none
    mixed, rounds = all_(pointsto.points_to(c, most=9)), all_(pointsto.points_to(c, most=0))
    flows = all_(summaries.summaries(copies, calls, own, most=4))
    monkeypatch.delattr(pointsto, "in_rounds", raising=True)
    monkeypatch.delattr(summaries, "reachable", raising=True)
    assert all_(pointsto.points_to(c)) == mixed == rounds  # before: rounds for every function
    assert all_(summaries.summaries(copies, calls, own)) == flows and flows


def test_programs_that_are_alike_are_collected_once(spark):
    from petrelspark.operators import likes

    d = spark.createDataFrame([("A", "f", [None, "x"]), ("B", "f", [None, "x"]), ("C", "f", ["x", None])], "net_id string, name string, args array<string>")
    seen = []

    def solve(t):
        seen.extend(sorted(r[0] for r in t.collect()))
        return t.select("net_id", "args")

    got = {r[0]: r[1] for r in likes.facts_once([d], solve).collect()}
    assert seen == ["A", "C"]  # before: where in an array a null stands was not told
    assert got == {"A": [None, "x"], "B": [None, "x"], "C": ["x", None]}


def test_programs_and_reductions_are_worked_out_once(spark, monkeypatch):
    from petrelspark import queries
    from petrelspark.operators import explore, reduce
    from petrelspark.plans import fixtures, programs

    seen, plain, shrink = [], explore.explore, reduce.reduced

    def nets(net):
        seen.append(net.places.select("net_id").distinct().count())
        return net

    monkeypatch.setattr(explore, "explore", lambda net, *a: plain(nets(net), *a))
    monkeypatch.setattr(reduce, "reduced", lambda net, *a: shrink(nets(net), *a))
    sf = "/root/testdata/sf0.001"
    for name, n in (("translate_tasks", 1), ("translate_states", len(programs.PROGRAMS)), ("reduce_trace", len(fixtures.REDUCIBLE))):
        seen.clear()
        assert queries.QUERIES[name](spark, sf).select("net_id").distinct().count() > n
        assert seen == [n]  # before: the net of each order


def test_nets_without_a_candidate_are_not_searched(spark, monkeypatch):
    from petrelspark.operators import detect, explore, likes
    from petrelspark.plans import fixtures

    places, steps = fixtures.NETS["N6"]
    nets = {"N6": (places, steps), "N7": fixtures.NETS["N7"], "other": (places, [t.replace("14:5", "7:5").replace("10:5", "99:1") for t in steps]), "same": (places, [t.replace("12:5", "10:5") for t in steps])}
    net, seen = fixtures.net(spark, nets), []
    rows = lambda d: sorted(map(str, d.collect()))
    want = [rows(f(explore.explore(net))) for f in (detect.atomicity, detect.net_witnesses)]
    monkeypatch.setattr(likes, "explore", lambda part: seen.append(sorted(r[0] for r in part.places.select("net_id").distinct().collect())) or explore.explore(part))
    assert [rows(likes.atomicity_once(net)), rows(likes.witnesses_once(net))] == want and all(want)
    # before: atomicity took each net, and the search those without an atomic step, too
    assert seen == [["N6"], ["N6"]]


def test_texts_that_are_equal_are_read_once(spark):
    from petrelspark.operators import likes

    texts, seen = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "path string, text string"), []

    def solve(some):
        seen.append(some.count())
        return some.where("text is not null").selectExpr("path", "text || '!' as said")

    assert sorted(map(tuple, likes.texts_once(texts, solve).collect())) == [("a", "x!"), ("b", "x!"), ("c", "y!")]
    assert seen[0] <= 3  # before: each text by itself
