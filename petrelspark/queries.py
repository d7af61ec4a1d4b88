"""The queries of the engine by name, each over whole tables or literal nets, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.functions import classify as C
from petrelspark.functions import markings as M
from petrelspark.operators import boundness, closure, collect, cycles, detect, elimination, explore, likes, pointsto, reduce, sequence, sleep, summaries, translate
from petrelspark.plans import derive, expected, fixtures, order_nets, programs, samples
from petrelspark.plans.net import Net
from petrelspark.sources import mir, sinks
from petrelspark.staging import counted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_ALLOWED = ", ".join(f"('{k}', '{s}')" for k, v in C.ALLOWED_STORES.items() for s in v)


def _csv(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


NETS = "WITH RECURSIVE " + order_nets.sql()
SPECIAL = "WITH " + order_nets.sql(special=True)
_ENABLED = "len(list_filter(list_zip(m, pre), lambda x: x[1] < x[2])) = 0"
_AFTER = "list_transform(list_zip(m, pre, post), lambda x: x[1] - x[2] + x[3])"
_FITS = "len(list_filter(list_zip(a, cap), lambda x: x[2] IS NOT NULL AND x[1] > x[2])) = 0"


def reach_sql(tables: str) -> str:
    """Reachable markings, and every firing from them."""
    return f"""{tables},
caps AS (SELECT net_id, cap FROM initial),
reach(net_id, m) AS (
  SELECT net_id, m FROM initial UNION
  SELECT net_id, a FROM (SELECT r.net_id, {_AFTER} AS a, i.cap FROM reach r JOIN firing f ON f.net_id = r.net_id JOIN caps i ON i.net_id = r.net_id WHERE {_ENABLED}) WHERE {_FITS}),
fired AS MATERIALIZED (SELECT *, {_FITS} AS fits FROM (SELECT r.net_id, r.m, f.trans_id, {_AFTER} AS a, i.cap FROM reach r JOIN firing f ON f.net_id = r.net_id JOIN caps i ON i.net_id = r.net_id WHERE {_ENABLED}))"""


REACH = reach_sql(NETS)
_DEALT = ",\n".join(f"{t} AS (SELECT key AS net_id, lit_{t}.* EXCLUDE (net_id) FROM lit_{t} JOIN spread ON name = net_id)" for t in ("functions", "blocks", "calls", "resources"))
PROGRAM = f"WITH RECURSIVE {programs.sql_facts(prefix='lit_')},\n{derive.spread_sql(list(programs.PROGRAMS))},\n{_DEALT},\n{programs.SQL}"
PROGRAM_REACH = reach_sql(f"{PROGRAM},\n{fixtures.DENSE}")

#: Every state with the transitions that first lead to it, and its number.  A walk keeps the least path to each marking it meets in a step; no state is
#: so many steps away.
PATHS = REACH + """,
walk(net_id, m, path) AS (
  SELECT net_id, m, CAST([] AS INTEGER[]) FROM initial UNION ALL
  SELECT net_id, a, list_append(path, trans_id) FROM (SELECT w.net_id, f.a, w.path, f.trans_id FROM walk w JOIN fired f ON f.net_id = w.net_id AND f.m = w.m WHERE f.fits AND len(w.path) < 40)
  QUALIFY row_number() OVER (PARTITION BY net_id, a ORDER BY path, trans_id) = 1),
best AS (SELECT net_id, m, min((len(path), path)) AS b FROM walk GROUP BY net_id, m),
numbered AS MATERIALIZED (SELECT net_id, m, row_number() OVER (PARTITION BY net_id ORDER BY b) - 1 AS state_id, b[2] AS path FROM best),
arrows AS MATERIALIZED (SELECT f.net_id, s.state_id AS src, f.trans_id, d.state_id AS dst FROM fired f JOIN numbered s ON s.net_id = f.net_id AND s.m = f.m JOIN numbered d ON d.net_id = f.net_id AND d.m = f.a WHERE f.fits)"""


def _net(spark: SparkSession, sf_dir: str, staged: bool = True) -> Net:
    return order_nets.nets(spark, sf_dir, staged=staged)


def _graph(spark: SparkSession, sf_dir: str) -> explore.StateGraph:
    """The state graphs of all orders' nets, of which nets that are alike share one."""
    return likes.explore_once(_net(spark, sf_dir))


def _once(spark: SparkSession, sf_dir: str, solve, places=(), transitions=()) -> DataFrame:
    """What ``solve`` gives for the state graphs of all orders' nets, once for those that are alike."""
    return likes.once(_net(spark, sf_dir), lambda net: solve(explore.explore(net)), places, transitions)


#: What detectors read of places, and of transitions that take locks.
_MARKS = ["name", "place_type"]
_LOCKS = ["ttype in ('Lock', 'RwLockRead', 'RwLockWrite') as locks", "case when ttype in ('Lock', 'RwLockRead', 'RwLockWrite') then res_place end as lock"]
#: What races read of transitions.
_UNSAFE = ["case when ttype in ('UnsafeRead', 'UnsafeWrite') then ttype end as access", "case when ttype in ('UnsafeRead', 'UnsafeWrite') then var end as location"]


def _races(g: explore.StateGraph) -> DataFrame:
    """(net_id, location, pairs): how many pairs of accesses race."""
    return detect.race_pairs(detect.accesses(g), ["net_id"]).groupBy("net_id", "location").agg(F.count("*").alias("pairs"))


@query(NETS + " SELECT net_id, array_to_string(m, ',') AS marking FROM initial")
def net_initial_marking(spark, sf_dir):
    return _net(spark, sf_dir, staged=False).initial().select("net_id", _csv("marking").alias("marking"))


@query(NETS + " SELECT net_id, place_id, trans_id, CAST(sum(CASE direction WHEN 'out' THEN weight WHEN 'in' THEN -weight ELSE 0 END) AS BIGINT) AS change FROM arcs GROUP BY ALL HAVING sum(CASE direction WHEN 'out' THEN weight WHEN 'in' THEN -weight ELSE 0 END) <> 0")
def net_incidence(spark, sf_dir):
    return _net(spark, sf_dir, staged=False).incidence()


@query(NETS + " SELECT net_id, place_id, trans_id, direction, weight FROM weights")
def net_arc_weights(spark, sf_dir):
    return _net(spark, sf_dir, staged=False).weights()


@query(NETS + f" SELECT i.net_id, trans_id FROM initial i JOIN firing f ON f.net_id = i.net_id WHERE {_ENABLED}")
def net_enabled(spark, sf_dir):
    n = _net(spark, sf_dir)
    return n.initial().join(n.firing(), "net_id").where(M.enabled(F.col("marking"), F.col("pre"))).select("net_id", "trans_id")


@query(NETS + f" SELECT i.net_id, trans_id, array_to_string({_AFTER}, ',') AS marking FROM initial i JOIN firing f ON f.net_id = i.net_id WHERE {_ENABLED}")
def net_fire(spark, sf_dir):
    n = _net(spark, sf_dir)
    on = n.initial().join(n.firing(), "net_id").where(M.enabled(F.col("marking"), F.col("pre")))
    return on.select("net_id", "trans_id", _csv(M.fire(F.col("marking"), F.col("pre"), F.col("post"))).alias("marking"))


@query(REACH + " SELECT net_id, array_to_string(m, ',') AS marking, trans_id, 'capacity' AS reason FROM fired WHERE NOT fits")
def net_fire_failures(spark, sf_dir):
    def failures(g):
        return g.failures.join(g.states, (g.failures["net_id"] == g.states["net_id"]) & (F.col("src") == F.col("state_id"))).select(g.failures["net_id"], _csv("marking").alias("marking"), "trans_id", "reason")

    return _once(spark, sf_dir, failures)


@query(SPECIAL + f" SELECT i.net_id, trans_id FROM initial i JOIN firing f ON f.net_id = i.net_id WHERE {_ENABLED} AND len(list_filter(list_zip(m, inh), lambda x: x[2] > 0 AND x[1] >= x[2])) = 0")
def net_inhibitor_enabled(spark, sf_dir):
    n = order_nets.nets(spark, sf_dir, special=True)
    return n.initial().join(n.firing(), "net_id").where(M.enabled(F.col("marking"), F.col("pre"), F.col("inhibitor"))).select("net_id", "trans_id")


@query(SPECIAL + f" SELECT i.net_id, trans_id, array_to_string(list_transform(list_zip({_AFTER}, rst), lambda x: CASE WHEN x[2] > 0 THEN 0 ELSE x[1] END), ',') AS marking FROM initial i JOIN firing f ON f.net_id = i.net_id WHERE {_ENABLED}")
def net_reset_fire(spark, sf_dir):
    n = order_nets.nets(spark, sf_dir, special=True)
    on = n.initial().join(n.firing(), "net_id").where(M.enabled(F.col("marking"), F.col("pre")))
    return on.select("net_id", "trans_id", _csv(M.fire(F.col("marking"), F.col("pre"), F.col("post"), F.col("reset"))).alias("marking"))


_DIAG = """ SELECT net_id, 'place' AS kind, place_id AS id, name, issue FROM (SELECT p.net_id, p.place_id, p.name, CASE WHEN t = 0 AND g = 0 THEN 'isolated' WHEN g = 0 AND p.tokens = 0 THEN 'never marked' WHEN t = 0 THEN 'sink' END AS issue FROM places p JOIN (SELECT p.net_id, p.place_id, count(*) FILTER (direction = 'in') AS t, count(*) FILTER (direction = 'out') AS g FROM places p LEFT JOIN weights w ON w.net_id = p.net_id AND w.place_id = p.place_id GROUP BY ALL) d ON d.net_id = p.net_id AND d.place_id = p.place_id) WHERE issue IS NOT NULL
UNION ALL SELECT net_id, 'transition', trans_id, name, issue FROM (SELECT x.net_id, x.trans_id, x.name, CASE WHEN t = 0 AND g = 0 THEN 'isolated' WHEN t = 0 THEN 'source' WHEN g = 0 THEN 'sink' END AS issue FROM transitions x JOIN (SELECT x.net_id, x.trans_id, count(*) FILTER (direction = 'in') AS t, count(*) FILTER (direction = 'out') AS g FROM transitions x LEFT JOIN weights w ON w.net_id = x.net_id AND w.trans_id = x.trans_id GROUP BY ALL) d ON d.net_id = x.net_id AND d.trans_id = x.trans_id) WHERE issue IS NOT NULL"""


@query(NETS + _DIAG)
def net_diagnostics(spark, sf_dir):
    return _net(spark, sf_dir, staged=False).diagnosis()


_TOUCH = "list_filter(list_transform(list_zip(pre, post), lambda x, i: CASE WHEN x[1] > 0 OR x[2] > 0 THEN i END), lambda x: x IS NOT NULL)"


@query(NETS + f", touch AS (SELECT net_id, trans_id, {_TOUCH} AS t FROM firing) SELECT a.net_id, a.trans_id AS t1, b.trans_id AS t2 FROM touch a JOIN touch b ON a.net_id = b.net_id AND a.trans_id < b.trans_id WHERE NOT list_has_any(a.t, b.t)")
def independence_matrix(spark, sf_dir):
    t = _net(spark, sf_dir).firing().select("net_id", "trans_id", M.touched(F.col("pre"), F.col("post")).alias("t"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.net_id") == F.col("b.net_id")) & (F.col("a.trans_id") < F.col("b.trans_id"))).where(M.independent(F.col("a.t"), F.col("b.t"))).select("a.net_id", F.col("a.trans_id").alias("t1"), F.col("b.trans_id").alias("t2"))


@query(REACH + " SELECT net_id, array_to_string(m, ',') AS marking FROM reach")
def reach_markings(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: g.states.select("net_id", _csv("marking").alias("marking")))


@query(REACH + " SELECT net_id, count(*) AS edges FROM fired WHERE fits GROUP BY net_id")
def reach_edge_count(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: g.edges.groupBy("net_id").agg(F.count("*").alias("edges")))


@query(REACH + " SELECT net_id, count(*) AS states, CAST(sum((SELECT count(*) FROM fired f WHERE f.net_id = r.net_id AND f.m = r.m AND f.fits)) AS BIGINT) AS edges, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM fired f WHERE f.net_id = r.net_id AND f.m = r.m) THEN 1 ELSE 0 END) AS BIGINT) AS deadlocks, false AS truncated FROM reach r GROUP BY net_id")
def reach_stats(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: g.stats())


@query(PATHS + """, kept AS (SELECT * FROM numbered WHERE state_id < 3),
tried AS (SELECT k.net_id, k.state_id, f.fits AND d.m IS NOT NULL AS edge FROM kept k JOIN fired f ON f.net_id = k.net_id AND f.m = k.m LEFT JOIN kept d ON d.net_id = f.net_id AND d.m = f.a),
of AS (SELECT net_id, state_id, count(*) FILTER (edge) AS edges FROM tried GROUP BY net_id, state_id)
SELECT k.net_id, count(*) AS states, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges, count(*) FILTER (of.state_id IS NULL) AS deadlocks, any_value(n > 3) AS truncated
FROM kept k LEFT JOIN of USING (net_id, state_id) JOIN (SELECT net_id, count(*) AS n FROM numbered GROUP BY net_id) USING (net_id) GROUP BY k.net_id""")
def reach_truncated(spark, sf_dir):
    return likes.once(_net(spark, sf_dir), lambda net: explore.explore(net, limit=3).stats())


#: Transitions that may go alone: they share no input place, nothing bounds what they give, and they take something.
_FREE = """free AS (
  SELECT w.net_id, w.trans_id FROM weights w JOIN places p USING (net_id, place_id) LEFT JOIN (SELECT net_id, place_id, count(DISTINCT trans_id) AS users, bool_or(direction <> 'in') AS special FROM weights WHERE direction <> 'out' GROUP BY ALL) u USING (net_id, place_id)
  WHERE w.direction IN ('in', 'out') GROUP BY w.net_id, w.trans_id HAVING NOT bool_or((w.direction = 'in' AND users > 1) OR coalesce(special, false) OR (w.direction = 'out' AND capacity IS NOT NULL))
  INTERSECT SELECT net_id, trans_id FROM (SELECT net_id, trans_id, place_id, sum(CASE direction WHEN 'out' THEN weight WHEN 'in' THEN -weight ELSE 0 END) AS change FROM weights GROUP BY ALL) WHERE change < 0),
moves AS (SELECT f.net_id, f.trans_id, pre, post, f.trans_id IN (SELECT trans_id FROM free x WHERE x.net_id = f.net_id) AS alone FROM firing f)"""
_CHOSEN = f"SELECT r.net_id, r.m, v.trans_id, {_AFTER} AS a, i.cap FROM less r JOIN moves v ON v.net_id = r.net_id JOIN caps i ON i.net_id = r.net_id WHERE {_ENABLED} QUALIFY coalesce(v.trans_id = min(CASE WHEN alone THEN v.trans_id END) OVER (PARTITION BY r.net_id, r.m), true)"


@query(REACH + f""", {_FREE}, less(net_id, m) AS (SELECT net_id, m FROM initial UNION SELECT net_id, a FROM ({_CHOSEN}) WHERE {_FITS}),
done AS (SELECT net_id, m, count(*) FILTER ({_FITS}) AS edges FROM ({_CHOSEN}) GROUP BY net_id, m)
SELECT l.net_id, count(*) AS states, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges, count(*) FILTER (done.m IS NULL) AS deadlocks, false AS truncated FROM less l LEFT JOIN done ON done.net_id = l.net_id AND done.m = l.m GROUP BY l.net_id""")
def reach_reduced(spark, sf_dir):
    return likes.once(_net(spark, sf_dir), lambda net: explore.explore_reduced(net).stats())


@query(REACH + " SELECT f.net_id, array_to_string(f.m, ',') AS marking, f.trans_id, CAST(k AS INTEGER) AS place_id, f.m[k + 1] AS before, f.a[k + 1] AS after FROM (SELECT *, unnest(range(len(m))) AS k FROM fired WHERE fits) f WHERE f.m[k + 1] <> f.a[k + 1]")
def reach_changes(spark, sf_dir):
    def changes(g):
        at = g.states.select("net_id", F.col("state_id").alias("src"), _csv("marking").alias("marking"))
        return g.changes().join(at, ["net_id", "src"]).select("net_id", "marking", "trans_id", "place_id", "before", "after")

    return _once(spark, sf_dir, changes)


@query(PATHS + " SELECT net_id, array_to_string(m, ',') AS marking, array_to_string(path, ',') AS path FROM numbered")
def reach_paths(spark, sf_dir):
    def paths(g):
        at = g.states.select("net_id", "state_id", _csv("marking").alias("marking"))
        return g.paths().join(at, ["net_id", "state_id"]).select("net_id", "marking", _csv("path").alias("path"))

    return _once(spark, sf_dir, paths)


_ENDED = """, ends AS (SELECT net_id, list(place_id ORDER BY place_id) FILTER (place_type = 'FunctionEnd' AND name LIKE '%main_end%') AS e FROM places GROUP BY net_id),
dead AS (SELECT r.net_id, r.m FROM reach r JOIN ends USING (net_id) WHERE NOT EXISTS (SELECT 1 FROM fired f WHERE f.net_id = r.net_id AND f.m = r.m AND f.fits) AND (e IS NULL OR len(list_filter(e, lambda x: r.m[x + 1] > 0)) = 0)),
marks AS (SELECT d.net_id, d.m, string_agg(p.name || ':' || d.m[p.place_id + 1], ',' ORDER BY p.name) FILTER (d.m[p.place_id + 1] > 0) AS marking FROM dead d JOIN places p ON p.net_id = d.net_id GROUP BY d.net_id, d.m)"""
_DEAD = REACH + _ENDED


@query(_DEAD + " SELECT net_id, coalesce(marking, '') AS marking FROM marks")
def deadlock_states(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: detect.deadlocks(g).select("net_id", "marking"), _MARKS)


@query(_DEAD + " SELECT net_id FROM initial WHERE net_id NOT IN (SELECT net_id FROM dead)")
def deadlock_none(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: g.net.places.select("net_id").distinct().join(detect.deadlocks(g).select("net_id"), "net_id", "left_anti"), _MARKS)


@query(PATHS + _ENDED + """ SELECT k.net_id, n.state_id, CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.net_id = k.net_id AND f.m = k.m) THEN 'capacity' ELSE 'no_enabled' END AS reason, coalesce(k.marking, '') AS marking, p.path
FROM marks k JOIN numbered n ON n.net_id = k.net_id AND n.m = k.m LEFT JOIN (SELECT s.net_id, state_id, string_agg(t.name, ',' ORDER BY pos) AS path FROM (SELECT net_id, state_id, unnest(path) AS trans_id, generate_subscripts(path, 1) AS pos FROM numbered) s JOIN transitions t USING (net_id, trans_id) GROUP BY s.net_id, state_id) p ON p.net_id = k.net_id AND p.state_id = n.state_id""")
def deadlock_report(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: detect.deadlock_report(g).withColumn("path", F.array_join("path", ",")), _MARKS, ["name"])


@query(PATHS + """, far(net_id, a, b) AS (SELECT DISTINCT net_id, src, dst FROM arrows UNION SELECT f.net_id, f.a, w.dst FROM far f JOIN arrows w ON w.net_id = f.net_id AND w.src = f.b),
bottom AS (SELECT p.net_id, p.a FROM far p LEFT JOIN far q ON q.net_id = p.net_id AND q.a = p.b AND q.b = p.a GROUP BY p.net_id, p.a HAVING count(*) = count(q.a)),
sets AS (SELECT net_id, a AS state_id, max(b) AS set FROM far JOIN bottom USING (net_id, a) GROUP BY net_id, a),
locks AS (SELECT net_id, trans_id, res_place AS lock FROM transitions WHERE ttype IN ('Lock', 'RwLockRead', 'RwLockWrite')),
can AS (SELECT s.net_id, set, count(DISTINCT s.state_id) AS states, min(s.state_id) AS least, coalesce(list(DISTINCT lock) FILTER (lock IS NOT NULL), []) AS can
  FROM sets s JOIN numbered n USING (net_id, state_id) LEFT JOIN fired f ON f.net_id = n.net_id AND f.m = n.m LEFT JOIN locks l ON l.net_id = s.net_id AND l.trans_id = f.trans_id GROUP BY s.net_id, set),
blocked AS (SELECT c.net_id, least, states, e.every, list_filter(e.every, lambda x: NOT list_contains(can, x)) AS locks FROM can c JOIN (SELECT net_id, list_sort(list(DISTINCT lock)) AS every FROM locks GROUP BY net_id) e USING (net_id))
SELECT net_id, array_to_string(locks, ',') AS locks, arg_min(states, least) AS states FROM blocked WHERE len(locks) > 0 AND len(locks) < len(every) GROUP BY net_id, locks""")
def deadlock_cycles(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: detect.blocked_cycles(g).select("net_id", _csv("locks").alias("locks"), "states"), transitions=_LOCKS)


@query(REACH + ", acc AS (SELECT DISTINCT f.net_id, array_to_string(f.m, ',') AS state, t.var AS location, t.ttype = 'UnsafeWrite' AS write, t.trans_id FROM fired f JOIN transitions t ON t.net_id = f.net_id AND t.trans_id = f.trans_id WHERE f.fits AND t.ttype IN ('UnsafeRead', 'UnsafeWrite')) SELECT a.net_id, a.location, count(*) AS pairs FROM acc a JOIN acc b ON a.net_id = b.net_id AND a.state = b.state AND a.location = b.location AND a.trans_id < b.trans_id AND (a.write OR b.write) GROUP BY ALL")
def race_states_on_net(spark, sf_dir):
    return _once(spark, sf_dir, _races, transitions=_UNSAFE)


_PAIRS = "WITH " + derive.SQL["access"] + ", pairs AS (SELECT a.state, a.location, a.ord AS a_ord, b.ord AS b_ord, a.op AS a_op, b.op AS b_op, a.block AS a_block, a.span AS a_span, b.span AS b_span, a.thread <> b.thread AS cross_thread FROM access a JOIN access b ON a.state = b.state AND a.location = b.location AND a.ord < b.ord AND (a.write OR b.write))"


@query(_PAIRS + " SELECT state, location, a_ord, b_ord, a_op, b_op FROM pairs")
def race_pairs(spark, sf_dir):
    return detect.race_pairs(derive.access(spark, sf_dir)).select("state", "location", "a_ord", "b_ord", "a_op", "b_op")


@query(_PAIRS + " , ops AS (SELECT location, a_block AS block, a_span AS span, a_op AS op, {'s': state, 'o': a_ord} AS pos, a_span AS place FROM pairs UNION ALL SELECT location, a_block, a_span, b_op, {'s': state, 'o': b_ord}, b_span FROM pairs), firsts AS (SELECT location, block, span, op, arg_min(place, pos) AS place, count(*) AS n FROM ops GROUP BY ALL) SELECT location, block, span, CAST(sum(n) // 2 AS BIGINT) AS pairs, string_agg(op || '@' || place, ',' ORDER BY op || '@' || place) AS operations FROM firsts GROUP BY location, block, span")
def race_merged(spark, sf_dir):
    return detect.merged_races(detect.race_pairs(derive.access(spark, sf_dir))).withColumn("operations", F.array_join("operations", ","))


@query(_PAIRS + " SELECT location, count(*) AS pairs, count(DISTINCT state) AS states FROM pairs WHERE cross_thread GROUP BY location")
def race_by_location(spark, sf_dir):
    return detect.race_counts(derive.access(spark, sf_dir))


_TRACE = "WITH " + derive.SQL["trace"] + """, rules(rule, s, m, e) AS (VALUES (1, 'load', 'store', 'store'), (2, 'store', 'store', 'load'), (3, 'load', 'store', 'load')),
lined AS (SELECT rule, s, m, e, idx, tid, var, kind, max(CASE WHEN kind = s THEN idx END) OVER w AS start_idx, max(CASE WHEN kind = e THEN idx END) OVER w AS prev FROM trace, rules WINDOW w AS (PARTITION BY rule, var, tid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (SELECT rule, m, var, tid AS tid_i, start_idx, idx AS end_idx, greatest(start_idx, coalesce(prev, start_idx)) AS after FROM lined WHERE kind = e AND start_idx IS NOT NULL),
found AS (SELECT rule, x.var, tid_i, t.tid AS tid_j, start_idx, max(t.idx) AS mid_idx, end_idx FROM ends x JOIN trace t ON t.var = x.var AND t.kind = x.m AND t.tid <> x.tid_i AND t.idx > x.after AND t.idx < x.end_idx GROUP BY ALL)"""


def _av(rule: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequence.binned_witnesses(derive.trace(spark, sf_dir)).where(F.col("rule") == rule).select("var", "tid_i", "tid_j", "start_idx", "mid_idx", "end_idx")

    run.__name__ = f"trace_av{rule}"
    query(_TRACE + f" SELECT var, tid_i, tid_j, start_idx, mid_idx, end_idx FROM found WHERE rule = {rule}")(run)


for _rule in (1, 2, 3):
    _av(_rule)


@query(_TRACE + " SELECT rule, count(*) AS witnesses, count(DISTINCT var) AS vars FROM found GROUP BY rule")
def trace_av_summary(spark, sf_dir):
    return sequence.binned_witnesses(derive.trace(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("witnesses"), F.countDistinct("var").alias("vars"))


@query(_TRACE + " SELECT rule, f.var, tid_i, tid_j, start_idx, mid_idx, end_idx, string_agg(t.idx || ':' || t.tid || ':' || t.kind, ',' ORDER BY t.idx) AS slice FROM found f JOIN trace t ON t.var = f.var AND t.idx BETWEEN start_idx AND end_idx GROUP BY ALL")
def trace_slice(spark, sf_dir):
    t = derive.trace(spark, sf_dir)
    return sequence.slices(t, sequence.binned_witnesses(t)).withColumn("slice", F.array_join("slice", ","))




_NAMED = ", ".join(f"'{o}'" for o in C.ORDERINGS)


@query(f"WITH ok(load, store) AS (VALUES {_ALLOWED}), o AS (SELECT event_id, ([{_NAMED}])[CAST(event_id % 5 AS INTEGER) + 1] AS load, ([{_NAMED}])[CAST(user_id % 5 AS INTEGER) + 1] AS store FROM events) SELECT event_id, load, store FROM o JOIN ok USING (load, store)")
def order_compatible_pairs(spark, sf_dir):
    named = lambda c: F.element_at(F.array(*[F.lit(o) for o in C.ORDERINGS]), (F.col(c) % 5 + 1).cast("int"))
    o = derive.table(spark, sf_dir, "events").select("event_id", named("event_id").alias("load"), named("user_id").alias("store"))
    return o.where(detect.compatible(F.col("load"), F.col("store")))


@query("WITH " + derive.SQL["memory_ops"] + f", ok(l, s) AS (VALUES {_ALLOWED}) SELECT a.state, a.var, a.span AS load, string_agg(DISTINCT b.span, ',' ORDER BY b.span) AS stores FROM memory_ops a JOIN memory_ops b ON a.state = b.state AND a.var = b.var AND a.kind = 'load' AND b.kind = 'store' JOIN ok ON ok.l = a.ordering AND ok.s = b.ordering GROUP BY a.state, a.var, a.span HAVING count(DISTINCT b.span) >= 2")
def atomic_store_sets(spark, sf_dir):
    return detect.store_sets(derive.memory_ops(spark, sf_dir)).withColumn("stores", F.array_join("stores", ","))


@query(PATHS + f""", e AS MATERIALIZED (SELECT a.*, ttype, var, ordering, span FROM arrows a JOIN transitions USING (net_id, trans_id)),
seen(net_id, root, node) AS (SELECT DISTINCT net_id, trans_id, dst FROM e WHERE ttype IN ('AtomicStore', 'AtomicCmpXchg') UNION SELECT s.net_id, s.root, e.dst FROM seen s JOIN e ON e.net_id = s.net_id AND e.src = s.node WHERE e.ttype <> 'Start'),
ok(l, s) AS (VALUES {_ALLOWED}),
hits AS (SELECT l.net_id, l.var, l.span AS load, l.src, t.span FROM (SELECT DISTINCT net_id, trans_id, src, var, ordering, span FROM e WHERE ttype = 'AtomicLoad') l JOIN seen ON seen.net_id = l.net_id AND seen.node = l.src JOIN transitions t ON t.net_id = l.net_id AND t.trans_id = seen.root AND t.var = l.var JOIN ok ON ok.l = l.ordering AND ok.s = t.ordering)
SELECT DISTINCT net_id, var, load, stores FROM (SELECT net_id, var, load, src, string_agg(DISTINCT span, ',' ORDER BY span) AS stores, count(DISTINCT span) AS n FROM hits GROUP BY net_id, var, load, src) WHERE n >= 2""")
def atomicity_on_net(spark, sf_dir):
    return likes.atomicity_once(_net(spark, sf_dir)).withColumn("stores", F.array_join("stores", ","))


@query(PATHS + """, e AS MATERIALIZED (SELECT a.*, var, tid, CASE WHEN ttype = 'AtomicLoad' THEN 'load' WHEN ttype IN ('AtomicStore', 'AtomicCmpXchg') THEN 'store' END AS kind FROM arrows a JOIN transitions USING (net_id, trans_id)),
rules(rule, s, m, e) AS (VALUES (1, 'load', 'store', 'store'), (2, 'store', 'store', 'load'), (3, 'load', 'store', 'load')),
search(net_id, v, i, rule, s, m, e, state, first, mid) AS (
  SELECT DISTINCT net_id, var, tid, rule, s, m, rules.e, CAST(0 AS BIGINT), -1, -1 FROM e, rules WHERE kind IS NOT NULL
  UNION SELECT net_id, v, i, rule, s, m, e, dst, CASE WHEN mine AND kind = s THEN trans_id ELSE first END, CASE WHEN mine AND (kind = s OR (kind = e AND first >= 0)) THEN -1 WHEN other AND kind = m AND first >= 0 THEN trans_id ELSE mid END
  FROM (SELECT x.*, w.dst, w.trans_id, w.kind, coalesce(w.var = x.v AND w.tid = x.i, false) AS mine, coalesce(w.var = x.v AND w.tid <> x.i, false) AS other FROM search x JOIN e w ON w.net_id = x.net_id AND w.src = x.state))
SELECT DISTINCT x.net_id, rule, v AS var, first AS start, mid, w.trans_id AS "end" FROM search x JOIN e w ON w.net_id = x.net_id AND w.src = x.state WHERE w.var = v AND w.tid = i AND w.kind = x.e AND first >= 0 AND mid >= 0""")
def atomicity_search(spark, sf_dir):
    return likes.witnesses_once(_net(spark, sf_dir))


_CALLS = "WITH RECURSIVE " + derive.SQL["calls"]


@query(_CALLS + ", r(node) AS (SELECT 0 UNION SELECT callee FROM calls JOIN r ON caller = node) SELECT node FROM r")
def call_reachable(spark, sf_dir):
    e = derive.calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return closure.reachable(e, spark.createDataFrame([(0, 0)], "root int, node int")).select("node")


@query(_CALLS + " SELECT caller, callee, string_agg(site_kind || '@' || location, ',' ORDER BY site_kind, location) AS sites, count(*) AS n_sites FROM calls GROUP BY caller, callee")
def call_edges_agg(spark, sf_dir):
    return closure.call_edges_aggregated(derive.calls(spark, sf_dir)).withColumn("sites", F.array_join(F.transform("sites", lambda s: F.concat_ws("@", s["site_kind"], s["location"])), ","))


@query(_CALLS + " SELECT callee, count(DISTINCT caller) AS callers, count(*) AS n_sites FROM calls GROUP BY callee")
def call_callers(spark, sf_dir):
    return derive.calls(spark, sf_dir).groupBy("callee").agg(F.countDistinct("caller").alias("callers"), F.count("*").alias("n_sites"))


@query(_CALLS + " SELECT caller, dest_local, string_agg(DISTINCT CAST(callee AS VARCHAR), ',' ORDER BY CAST(callee AS VARCHAR)) AS callees FROM calls WHERE site_kind IN ('spawn', 'scope_spawn') GROUP BY caller, dest_local")
def call_spawn_map(spark, sf_dir):
    m = closure.spawn_map(derive.calls(spark, sf_dir))
    return m.withColumn("callees", F.array_join(F.array_sort(F.transform("callees", lambda x: x.cast("string"))), ","))


_GROUPS = "WITH RECURSIVE " + derive.SQL["lock_links"] + ", both_ways AS (SELECT a, b FROM lock_links UNION SELECT b, a FROM lock_links), lab(node, l) AS (SELECT a, a FROM both_ways UNION SELECT b, l FROM lab JOIN both_ways ON a = node), comp AS (SELECT node, min(l) AS component FROM lab GROUP BY node)"


@query(_GROUPS + " SELECT node, component FROM comp")
def lock_groups(spark, sf_dir):
    from petrelspark.operators.components import connected_components

    return connected_components(derive.lock_links(spark, sf_dir))


@query(_GROUPS + " SELECT component, CASE WHEN component % 3 = 0 THEN 'rwlock' ELSE 'mutex' END AS kind, count(*) AS members, CAST(CASE WHEN component % 3 = 0 THEN 10 ELSE 1 END AS BIGINT) AS tokens FROM comp GROUP BY component")
def resource_places(spark, sf_dir):
    links = derive.lock_links(spark, sf_dir)
    guards = links.select(F.col("a").alias("guard")).union(links.select("b")).distinct().select("guard", F.when(F.col("guard") % 3 == 0, "rwlock").otherwise("mutex").alias("kind"))
    return translate.lock_groups(links, guards).select("component", "kind", "members", "tokens")


_PTS = "WITH RECURSIVE " + derive.SQL["constraints"] + ", nodes AS (SELECT src AS n FROM cons UNION SELECT dst FROM cons), pts(node, target) AS (SELECT * FROM (SELECT n, 'Alloc(' || n || ')' FROM nodes UNION SELECT dst, src FROM cons WHERE kind = 'Address') UNION SELECT c.dst, p.target FROM pts p JOIN cons c ON c.kind = 'Copy' AND c.src = p.node)"


def _pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointsto.points_to(derive.constraints(spark, sf_dir))


@query(_PTS + " SELECT node, target FROM pts")
def points_to_small(spark, sf_dir):
    return _pts(spark, sf_dir).select("node", "target")


@query()
def points_to_full(spark, sf_dir):
    return pointsto.points_to(derive.all_constraints(spark, sf_dir)).select("node", "target")


_KIND = ", q AS (SELECT DISTINCT 'v' || (c_custkey % 211) AS a, 'v' || c_nationkey AS b FROM customer), k AS (SELECT a, b, CASE WHEN NOT EXISTS (SELECT 1 FROM pts WHERE node = a) OR NOT EXISTS (SELECT 1 FROM pts WHERE node = b) THEN 'Unknown' WHEN EXISTS (SELECT 1 FROM pts x JOIN pts y ON x.target = y.target WHERE x.node = a AND y.node = b) THEN 'Probably' ELSE 'Unlikely' END AS kind FROM q)"


@query(_PTS + _KIND + " SELECT a, b, kind FROM k")
def alias_pairs(spark, sf_dir):
    return pointsto.aliases(_pts(spark, sf_dir), derive.alias_queries(spark, sf_dir)).select("a", "b", "kind")


@query(_PTS + _KIND + " SELECT kind, count(*) AS pairs, kind IN ('Probably', 'Possibly') AS may, kind <> 'Unlikely' AS may_conservative FROM k GROUP BY kind")
def may_alias_policy(spark, sf_dir):
    k = pointsto.aliases(_pts(spark, sf_dir), derive.alias_queries(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("pairs"))
    return k.select("kind", "pairs", C.may_alias(F.col("kind")).alias("may"), C.may_alias(F.col("kind"), True).alias("may_conservative"))


def _values(names: list[str]) -> str:
    return derive.spread_sql(names) + ", names AS (SELECT key, name FROM spread)"


def _rx(patterns: list[str]) -> str:
    return "regexp_matches(name, '" + C.any_of(patterns) + "')"


def _contains(parts: list[str], what: str = "name") -> str:
    return "(" + " OR ".join(f"contains({what}, '{p}')" for p in parts) + ")"


@query(f"WITH {_values(samples.FUNCTIONS)} SELECT key, name, CASE WHEN {_contains(C.RAYON_JOIN)} THEN 'rayon_join' WHEN {_rx(C.SCOPE_SPAWN)} THEN 'scope_spawn' WHEN {_rx(C.SCOPE_JOIN)} THEN 'scope_join' WHEN {_contains(C.ASYNC_SPAWN)} THEN 'async_spawn' WHEN contains(name, 'tokio::task::JoinHandle') AND {_contains(['await', 'blocking_on'])} THEN 'async_join' WHEN {_rx(C.THREAD_SPAWN)} THEN 'spawn' WHEN {_rx(C.THREAD_JOIN)} THEN 'join' END AS kind FROM names")
def classify_threads(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.FUNCTIONS).select("key", "name", C.thread_control(F.col("name")).alias("kind"))


_HEAD = "string_split(name, '<')[1]"


@query(f"WITH {_values(samples.TYPES)} SELECT key, name, CASE WHEN {_contains(C.FOREIGN_RUNTIMES, _HEAD)} THEN NULL ELSE CASE WHEN contains({_HEAD}, 'spin') THEN 'Spin' WHEN {_contains(['lock_api', 'parking_lot'], _HEAD)} THEN 'ParkingLot' ELSE 'Std' END || CASE WHEN contains({_HEAD}, 'MutexGuard') THEN 'Mutex' WHEN contains({_HEAD}, 'RwLockReadGuard') THEN 'Read' WHEN contains({_HEAD}, 'RwLockWriteGuard') THEN 'Write' END END AS kind FROM names")
def classify_guards(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.TYPES).select("key", "name", C.lock_guard(F.col("name")).alias("kind"))


@query(f"WITH {_values(samples.TYPES)} SELECT key, name, CASE WHEN starts_with(name, 'std::sync::mpsc::Sender') THEN 'mpsc.sender' WHEN starts_with(name, 'std::sync::mpsc::Receiver') THEN 'mpsc.receiver' WHEN starts_with(name, 'std::sync::mpsc::SyncSender') THEN 'sync.sender' END AS kind FROM names")
def classify_channels(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.TYPES).select("key", "name", C.channel_endpoint(F.col("name")).alias("kind"))


@query(f"WITH {_values(samples.FUNCTIONS)}, k AS (SELECT key, name, CASE WHEN contains(name, '::load') THEN 'read' WHEN contains(name, '::store') THEN 'write' WHEN {_contains(C.RMW)} THEN 'read_write' END AS kind FROM names) SELECT key, name, kind, CASE kind WHEN 'read' THEN 1 WHEN 'write' THEN 2 WHEN 'read_write' THEN 4 END AS ordering_at FROM k")
def classify_atomics(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.FUNCTIONS).select("key", "name", C.atomic_api(F.col("name")).alias("kind"), C.ordering_argument(F.col("name"), F.lit(5)).alias("ordering_at"))


@query(f"WITH {_values(samples.FUNCTIONS)}, l AS (SELECT key, name AS full_name, lower(name) AS name FROM names) SELECT key, full_name AS name, CASE WHEN {_rx(C.CONDVAR_NOTIFY)} THEN 'condvar_notify' WHEN {_rx(C.CONDVAR_WAIT)} THEN 'condvar_wait' WHEN {_rx(C.CHANNEL_SEND)} THEN 'channel_send' WHEN {_rx(C.CHANNEL_RECV)} THEN 'channel_recv' WHEN {_rx(C.ATOMIC_LOAD)} THEN 'atomic_load' WHEN {_rx(C.ATOMIC_STORE)} THEN 'atomic_store' END AS kind FROM l")
def classify_synchronization(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.FUNCTIONS).select("key", "name", C.synchronization(F.col("name")).alias("kind"))


@query(f"WITH {_values(samples.FUNCTIONS)} SELECT key, name FROM names WHERE {_contains(C.IGNORED)}")
def ignored_functions(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.FUNCTIONS).where(C.ignored(F.col("name")))


@query(f"WITH {_values(samples.FUNCTIONS)} SELECT key, name FROM names WHERE (starts_with(name, 'app') OR starts_with(name, 'lib')) AND NOT starts_with(name, 'app::tests')")
def crate_filter(spark, sf_dir):
    return derive.spread(spark, sf_dir, samples.FUNCTIONS).where(C.in_crates(F.col("name"), "app", white=["app", "lib"], black=["app::tests"]))


@query("WITH " + derive.SQL["endpoints"] + " SELECT site, min(endpoint) FILTER (role = 'sender') AS sender, min(endpoint) FILTER (role = 'receiver') AS receiver FROM endpoints GROUP BY site HAVING count(*) = 2 AND count(*) FILTER (role = 'sender') = 1 AND count(*) FILTER (role = 'receiver') = 1")
def channel_pairs(spark, sf_dir):
    return translate.channel_pairs(derive.endpoints(spark, sf_dir))


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'signup'), j AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase') SELECT j.user_id, j.event_id AS join_ord, s.event_id AS spawn_ord, s.event_id AS callee FROM j JOIN s USING (user_id, k)")
def join_fifo(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id", F.col("event_id").alias("ord"), F.col("event_id").alias("callee"))
    return translate.fifo_joins(of("signup"), of("purchase"), ["user_id"])


@query(f"WITH e AS (SELECT event_id, user_id, {derive.K} AS k, event_type FROM events) SELECT o.event_id AS op, min(r.user_id) AS place FROM e o LEFT JOIN (SELECT DISTINCT k, user_id FROM e WHERE event_type = 'signup') r ON r.k = o.k WHERE o.event_type = 'purchase' GROUP BY o.event_id")
def first_match_resource(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", derive._k().alias("alias"))
    resources = e.where("event_type = 'signup'").groupBy("alias").agg(F.min("user_id").alias("place"))
    return translate.resource_of(e.where("event_type = 'purchase'").select(F.col("event_id").alias("op"), "alias"), resources, first=True)


#: What reduction reads of places and transitions.
_REDUCED = ["place_type"], ["name", "ttype"]


def _stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def sizes(net):
        n = reduce.reduced(net)[name]
        return n.transitions.groupBy("net_id").agg(F.count("*").alias("transitions")).join(n.places.groupBy("net_id").agg(F.count("*").alias("places")), "net_id", "outer").na.fill(0)

    return likes.once(_spread_net(spark, sf_dir, fixtures.REDUCIBLE), sizes, *_REDUCED)


@query(expected.spread("reduce_loops", list(fixtures.REDUCIBLE)))
def reduce_loops(spark, sf_dir):
    return _stage(spark, sf_dir, "loops")


@query(expected.spread("reduce_sequences", list(fixtures.REDUCIBLE)))
def reduce_sequences(spark, sf_dir):
    return _stage(spark, sf_dir, "sequences")


@query(expected.spread("reduce_intermediate", list(fixtures.REDUCIBLE)))
def reduce_intermediate(spark, sf_dir):
    return _stage(spark, sf_dir, "intermediate")


@query(expected.spread("reduce_trace", list(fixtures.REDUCIBLE)))
def reduce_trace(spark, sf_dir):
    result = lambda net: reduce.reduced(net)["result"].transitions.select("net_id", "trans_id", "name", "ttype", _csv("orig_ids").alias("orig_ids"))
    return likes.once(_spread_net(spark, sf_dir, fixtures.REDUCIBLE), result, *_REDUCED)


_TEXTS = [path for path, _ in samples.PROGRAMS]


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample texts, of which every order has one under its own path."""
    return derive.renamed(spark.createDataFrame(samples.PROGRAMS, "path string, text string"), derive.spread(spark, sf_dir, _TEXTS), "path")


_LINES = "WITH lit_texts(path, text) AS (VALUES " + ", ".join(f"('{p}', '" + t.replace("'", "''") + "')" for p, t in samples.PROGRAMS) + "), " + derive.spread_sql(_TEXTS) + ", texts AS (SELECT key AS path, text FROM lit_texts JOIN spread ON name = path), l AS (SELECT path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM texts), s AS (SELECT path, line, trim(raw) AS s FROM l)"


@query(_LINES + ", f AS (SELECT *, last_value(CASE WHEN starts_with(s, 'fn ') AND ends_with(s, '{') THEN split_part(substr(s, 4), '(', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS fn FROM s) SELECT path, fn, line AS bb_line, CAST(replace(split_part(split_part(s, ':', 1), ' ', 1), 'bb', '') AS INTEGER) AS bb, contains(s, '(cleanup)') AS cleanup FROM f WHERE starts_with(s, 'bb') AND ends_with(s, '{')")
def mir_blocks(spark, sf_dir):
    return mir.blocks(mir.lines(_programs(spark, sf_dir))).select("path", "fn", "bb_line", "bb", "cleanup")


@query(expected.spread("mir_terminators", _TEXTS, "path"))
def mir_terminators(spark, sf_dir):
    return mir.blocks(mir.lines(_programs(spark, sf_dir))).select("path", "fn", "bb", "kind", _csv("targets").alias("targets"), "callee", "dest", "dropped")


@query(_LINES + " SELECT path, trim(split_part(replace(replace(s, 'let mut ', ''), 'let ', ''), ':', 1)) AS local, trim(replace(substr(s, strpos(s, ':') + 1), ';', '')) AS ty, starts_with(s, 'let mut ') AS is_mut FROM s WHERE starts_with(s, 'let ')")
def mir_locals(spark, sf_dir):
    return mir.local_decls(mir.lines(_programs(spark, sf_dir))).select("path", "local", "ty", "is_mut")


@query(expected.spread("mir_net", _TEXTS, "path"))
def mir_net(spark, sf_dir):
    n = lambda d, k: d.groupBy("path").agg(F.count("*").alias(k))

    def sizes(texts):
        r = mir.net_rows(texts)
        return n(r["places"], "places").join(n(r["transitions"], "transitions"), "path").join(n(r["arcs"], "arcs"), "path")

    return likes.texts_once(_programs(spark, sf_dir), sizes)


@query(expected.spread("mir_warnings", _TEXTS, "path"))
def mir_warnings(spark, sf_dir):
    return likes.texts_once(_programs(spark, sf_dir), lambda texts: mir.net_rows(texts)["warnings"])


@query()
def mir_pnml(spark, sf_dir):
    return likes.texts_once(_programs(spark, sf_dir), lambda texts: sinks.pnml(mir.net_rows(texts)))


@query()
def net_dot(spark, sf_dir):
    return sinks.net_dot(_net(spark, sf_dir, staged=False))


@query()
def state_graph_dot(spark, sf_dir):
    return _once(spark, sf_dir, sinks.graph_dot, ["name"], ["name"])


_UNBOUNDED = fixtures.GENERATOR | {"N2": fixtures.NETS["N2"], "N7": fixtures.NETS["N7"]}


@query(expected.spread("coverability", list(_UNBOUNDED)))
def coverability(spark, sf_dir):
    omega = F.array_join(F.transform("marking", lambda x: x.cast("string")), ",", "w")
    nodes = likes.once(_spread_net(spark, sf_dir, _UNBOUNDED), boundness.coverability)
    return nodes.select("net_id", "depth", omega.alias("marking"), _csv("path").alias("path"))


@query(expected.spread("boundedness", list(_UNBOUNDED)))
def boundedness(spark, sf_dir):
    return likes.once(_spread_net(spark, sf_dir, _UNBOUNDED), boundness.boundedness).withColumn("witness", _csv("witness"))


@query(expected.spread("invariants", list(fixtures.NETS)))
def invariants(spark, sf_dir):
    return boundness.invariants(_spread_net(spark, sf_dir, fixtures.NETS))


@query(REACH + " SELECT p.net_id, count(DISTINCT p.place_id) AS places, (SELECT count(*) FROM transitions t WHERE t.net_id = p.net_id) AS transitions, (SELECT count(*) FROM weights w WHERE w.net_id = p.net_id) AS arcs, (SELECT count(*) FROM reach r WHERE r.net_id = p.net_id) AS states, (SELECT count(*) FROM fired f WHERE f.net_id = p.net_id AND f.fits) AS edges FROM places p GROUP BY p.net_id")
def summary_metrics(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return sinks.summary(g, detect.deadlocks(g)).select("net_id", "places", "transitions", "arcs", "states", "edges")


def _spread_net(spark: SparkSession, sf_dir: str, nets: dict) -> Net:
    """Every order with one of some literal nets."""
    n, given = fixtures.net(spark, nets), derive.spread(spark, sf_dir, list(nets))
    return Net(*(counted(derive.renamed(d, given), "net") for d in (n.places, n.transitions, n.arcs)))


def _program(spark: SparkSession, sf_dir: str) -> Net:
    """The nets of the literal programs, of which every order runs one."""
    given = derive.spread(spark, sf_dir, list(programs.PROGRAMS))
    return translate.translate_once(*[derive.renamed(d, given) for d in programs.facts(spark)])


def _counted_graph(n: Net) -> explore.StateGraph:
    return explore.explore(Net(counted(n.places, "places"), counted(n.transitions, "transitions"), counted(n.arcs, "arcs")))


def _program_graph(spark: SparkSession, sf_dir: str) -> explore.StateGraph:
    return _counted_graph(_program(spark, sf_dir))


def _programs_once(spark: SparkSession, sf_dir: str, solve) -> DataFrame:
    """What ``solve`` gives for the state graphs of the literal programs' nets, translated and explored once for programs with the same facts."""
    given = derive.spread(spark, sf_dir, list(programs.PROGRAMS))
    return likes.facts_once([derive.renamed(d, given) for d in programs.facts(spark)], lambda *facts: solve(_counted_graph(translate.translate(*facts))))


@query(PROGRAM + " SELECT net_id, name, CAST(tokens AS BIGINT) AS tokens, CAST(capacity AS BIGINT) AS capacity, place_type FROM places")
def translate_places(spark, sf_dir):
    return _program(spark, sf_dir).places.select("net_id", "name", "tokens", "capacity", "place_type")


@query(PROGRAM + " SELECT net_id, name, ttype, var, ordering FROM transitions")
def translate_transitions(spark, sf_dir):
    return _program(spark, sf_dir).transitions.select("net_id", "name", "ttype", "var", "ordering")


@query(PROGRAM + " SELECT net_id, place_id, trans_id, direction, weight FROM weights")
def translate_arcs(spark, sf_dir):
    return _program(spark, sf_dir).weights()


@query(PROGRAM_REACH + " SELECT r.net_id, count(*) AS states, (SELECT count(*) FROM fired f WHERE f.net_id = r.net_id AND f.fits) AS edges FROM reach r GROUP BY r.net_id")
def translate_states(spark, sf_dir):
    return _programs_once(spark, sf_dir, lambda g: g.stats().select("net_id", "states", "edges"))


@query(PROGRAM_REACH + _ENDED + " SELECT net_id, coalesce(marking, '') AS marking FROM marks")
def translate_deadlock(spark, sf_dir):
    return _programs_once(spark, sf_dir, lambda g: detect.deadlocks(g).select("net_id", "marking"))


@query(PROGRAM_REACH + ", acc AS (SELECT DISTINCT f.net_id, array_to_string(f.m, ',') AS state, t.var AS location, t.ttype = 'UnsafeWrite' AS write, t.trans_id FROM fired f JOIN transitions t ON t.net_id = f.net_id AND t.trans_id = f.trans_id WHERE f.fits AND t.ttype IN ('UnsafeRead', 'UnsafeWrite')) SELECT a.net_id, a.location, count(*) AS pairs FROM acc a JOIN acc b ON a.net_id = b.net_id AND a.state = b.state AND a.location = b.location AND a.trans_id < b.trans_id AND (a.write OR b.write) GROUP BY ALL")
def translate_race(spark, sf_dir):
    return _programs_once(spark, sf_dir, _races)


@query(expected.spread("translate_atomicity", list(programs.PROGRAMS)))
def translate_atomicity(spark, sf_dir):
    return _programs_once(spark, sf_dir, lambda g: detect.atomicity(g).withColumn("stores", F.array_join("stores", ",")))


@query(expected.spread("translate_tasks", ["jobs"]))
def translate_tasks(spark, sf_dir):
    given = derive.spread(spark, sf_dir, ["jobs"])
    tasks = derive.renamed(spark.createDataFrame([("jobs", "a", 0), ("jobs", "b", 1)], "net_id string, task string, awaits int"), given)

    def stats(tasks):
        net = translate.as_net(counted(translate.task_rows(tasks), "net-rows"))
        places = net.places.withColumn("tokens", F.when(F.col("name").endswith("_ready"), 1).otherwise(F.col("tokens")).cast("long"))
        return _counted_graph(Net(places, net.transitions, net.arcs)).stats()

    return likes.facts_once([tasks], stats)


def _app(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sample program as locals, call sites and statements, once for every order, which leaves out a third of the call sites."""
    given = derive.spread(spark, sf_dir, ["app"])
    rows = {k: counted(derive.renamed(spark.createDataFrame(r, s), given), k) for k, (s, r) in samples.APP.items()}
    return rows | {"some": rows["sites"].where("(cast(net_id as long) + bb) % 3 != 0")}


@query(expected.spread("collect_calls", ["app"]).replace("e.* FROM", "e.* REPLACE (CASE WHEN action = 'join' AND CAST(key AS BIGINT) % 3 = 0 THEN NULL ELSE callee END AS callee) FROM") + " WHERE (CAST(key AS BIGINT) + bb) % 3 <> 0")
def collect_calls(spark, sf_dir):
    a = _app(spark, sf_dir)
    return likes.facts_once([a[k] for k in ("some", "locals", "owners", "functions")], collect.dispatched).select("net_id", "func", "bb", "action", "callee", "res", "res2", "ordering", F.array_join("callees", "+").alias("callees"))


@query(expected.spread("collect_call_edges", ["app"]))
def collect_call_edges(spark, sf_dir):
    a = _app(spark, sf_dir)
    return likes.facts_once([a[k] for k in ("sites", "locals", "functions")], collect.call_sites).select("net_id", "caller", "callee", "site_kind", "location")


@query(expected.spread("collect_resources", ["app"]))
def collect_resources(spark, sf_dir):
    a = _app(spark, sf_dir)
    local = a["locals"]
    of = lambda d, at, *what: d.select("net_id", "func", at.alias("local"), F.concat_ws(" ", *what).alias("what"))
    ops = collect.atomic_variables(collect.atomic_operations(a["sites"]))
    unsafe = collect.unsafe_blocks(collect.unsafe_accesses(a["statements"]))
    at = F.col("local")
    guards, ends = of(collect.lock_guards(local), at, F.lit("guard"), "maker", "kind"), of(collect.channel_ends(local), at, "kind", "data")
    atomics = of(ops, at, F.lit("atomic"), "ordering", F.array_join("operations", "+"))
    blocks = of(unsafe, F.concat(F.lit("bb"), F.col("bb").cast("string")), F.lit("unsafe"), F.array_join("spans", "+"))
    return guards.union(of(collect.condvars(local), at, F.lit("condvar"))).union(ends).union(atomics).union(blocks)


@query(REACH + " SELECT r.net_id, count(*) AS states, count(*) FILTER (f.m IS NULL) AS deadlocks FROM reach r LEFT JOIN (SELECT DISTINCT net_id, m FROM fired) f ON f.net_id = r.net_id AND f.m = r.m GROUP BY r.net_id")
def reach_asleep(spark, sf_dir):
    return likes.once(_net(spark, sf_dir), lambda net: sleep.explore_asleep(net).stats().select("net_id", "states", "deadlocks"))


@query(PATHS + """, far(net_id, a, b) AS (SELECT DISTINCT net_id, src, dst FROM arrows UNION SELECT f.net_id, f.a, w.dst FROM far f JOIN arrows w ON w.net_id = f.net_id AND w.src = f.b),
turning AS (SELECT p.net_id, p.a, least(p.a, min(p.b)) AS component FROM far p JOIN far q ON q.net_id = p.net_id AND q.a = p.b AND q.b = p.a GROUP BY p.net_id, p.a),
leaving AS (SELECT DISTINCT t.net_id, t.component FROM turning t JOIN arrows w ON w.net_id = t.net_id AND w.src = t.a LEFT JOIN turning d ON d.net_id = w.net_id AND d.a = w.dst WHERE d.component IS DISTINCT FROM t.component)
SELECT t.net_id, t.component, count(*) AS states, any_value(l.component IS NULL) AS closed FROM turning t LEFT JOIN leaving l ON l.net_id = t.net_id AND l.component = t.component GROUP BY t.net_id, t.component""")
def graph_cycles(spark, sf_dir):
    return _once(spark, sf_dir, lambda g: cycles.cycles(g).select("net_id", "component", "states", "closed"), transitions=_LOCKS)


@query("WITH RECURSIVE " + derive.SQL["customer_calls"] + ", nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges), far(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM far JOIN edges ON src = b) SELECT n AS node, least(n, coalesce(min(q.a), n)) AS component FROM nodes LEFT JOIN far p ON p.a = n LEFT JOIN far q ON q.a = p.b AND q.b = p.a GROUP BY n")
def call_components(spark, sf_dir):
    return cycles.strong_components(derive.customer_calls(spark, sf_dir))


def _points_to_sql(constraints: str, fields: str = "") -> str:
    """The least solution by a recursion over facts (p) and copies (c), which join all that is known with all that is known."""
    return f"""WITH RECURSIVE {constraints}, nodes AS (SELECT func, src AS n FROM cons UNION SELECT func, dst FROM cons),
t(tag, func, a, b) USING KEY (tag, func, a, b) AS (
  SELECT 'p', func, n, 'Alloc(' || n || ')' FROM nodes UNION SELECT 'p', func, dst, src FROM cons WHERE kind = 'Address' UNION SELECT 'c', func, src, dst FROM cons WHERE kind = 'Copy'{fields}
  UNION (SELECT 'p', r.func, c.b, r.b FROM recurring.t r JOIN recurring.t c ON c.func = r.func AND c.a = r.a WHERE r.tag = 'p' AND c.tag = 'c'
    UNION SELECT 'c', r.func, r.b, l.dst FROM recurring.t r JOIN cons l ON l.func = r.func AND l.src = r.a WHERE r.tag = 'p' AND l.kind = 'Load' AND NOT starts_with(r.b, 'Alloc(')
    UNION SELECT 'c', r.func, l.src, r.b FROM recurring.t r JOIN cons l ON l.func = r.func AND l.dst = r.a WHERE r.tag = 'p' AND l.kind = 'Store' AND NOT starts_with(r.b, 'Alloc(')))
SELECT func, a AS node, b AS target FROM t WHERE tag = 'p'"""


@query(_points_to_sql(derive.SQL["function_constraints"]))
def points_to_functions(spark, sf_dir):
    return pointsto.points_to(derive.function_constraints(spark, sf_dir))


@query(_points_to_sql(derive.SQL["field_constraints"], " UNION SELECT 'c', a.func, a.n, b.n FROM nodes a JOIN nodes b ON b.func = a.func AND starts_with(b.n, a.n || '.')"))
def points_to_fields(spark, sf_dir):
    return pointsto.points_to(derive.field_constraints(spark, sf_dir), fields=True)


@query("WITH RECURSIVE " + derive.SQL["flows"] + """, spots AS (SELECT row_number() OVER () AS site, * FROM calls), spot AS (SELECT site, func, callee, '_1' AS inner_, src AS outer_ FROM spots UNION ALL SELECT site, func, callee, '_2', dst FROM spots UNION ALL SELECT site, func, callee, '_0', dest FROM spots),
sites AS (SELECT a.func, a.callee, a.inner_ AS i, b.inner_ AS j, a.outer_ AS x, b.outer_ AS y FROM spot a JOIN spot b USING (site) WHERE a.inner_ <> '_0' AND a.inner_ <> b.inner_ AND a.outer_ <> b.outer_),
t(tag, func, a, b) USING KEY (tag, func, a, b) AS (
  SELECT 'e', func, src, dst FROM copies UNION SELECT 'r', func, p, p FROM functions, (VALUES ('_1'), ('_2')) v(p)
  UNION (SELECT 'r', r.func, r.a, e.b FROM recurring.t r JOIN recurring.t e ON e.func = r.func AND e.a = r.b WHERE r.tag = 'r' AND e.tag = 'e'
    UNION SELECT 'e', s.func, s.x, s.y FROM recurring.t r JOIN sites s ON s.callee = r.func AND s.i = r.a AND s.j = r.b WHERE r.tag = 'r'))
SELECT func, a AS source, b AS goal FROM t WHERE tag = 'r' AND a <> b AND b IN ('_0', '_1', '_2')""")
def flow_summaries(spark, sf_dir):
    return summaries.summaries(*derive.flows(spark, sf_dir))


@query()
def invariant_bounds(spark, sf_dir):
    return elimination.covered(_net(spark, sf_dir))


@query()
def invariant_basis(spark, sf_dir):
    basis = elimination.null_spaces(_net(spark, sf_dir), "transition")
    return basis.select("net_id", "number", F.array_join(F.transform(F.array_sort(F.map_entries("own")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("vector"))
