"""Nets from the given tables: one for each order, so their number grows with the data and their size with an order's line items.

An order is a program: its main thread spawns one or two threads and joins them, and its line items are their steps, dealt in turn.  What a
step does follows its line item:

* return flag ``N``: the thread locks one of the order's three locks (by the supplier) unless it holds it, and keeps it;
* ``R``: an unsafe write (line status ``O``) or read (``F``) of one of four variables (by the part);
* ``A``: an atomic store (``O``) or load (``F``) of one of the four, with an ordering by the supplier.

A thread gives its locks back after its last step, so two threads that take two locks in opposite order may deadlock.  Orders with status ``O``
start at the beginning, all others with their threads spawned.  Some have defects that analysis has to find:

* status ``P``: a step that meets a lock which its thread holds gives it back at once, and the thread does so again at its end, so a lock may run over;
* priority ``5-LOW``: the first thread starts again when it is done, and the second one keeps its locks for good.

``special`` adds arcs that most nets don't have: a read waits until the lock of its supplier is taken (inhibitor), and a write empties that
lock's place (reset).  ``ticking`` adds a place without a bound to orders with status ``P``, which a transition fills while the threads are
waited for.  ``sql`` has the same as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.plans.fixtures import DENSE
from petrelspark.plans.net import Net
from petrelspark.staging import join_by_size, stage

ORDERINGS = ["Relaxed", "Release", "Acquire", "AcqRel", "SeqCst"]
_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net_id, of_status, again, n0, n1, k, thread, j, lock, takes, flag, status, var, ordering, span): orders with their line items as steps of their threads.

    ``n0`` and ``n1`` are the steps of each thread; an order without line items has one row, in which all of the step is null.  Line items are
    dealt once, by net: all windows and the join keep that."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("net_id", F.col("l_orderkey").cast("string"))
    k = li.selectExpr("*", f"row_number() over (partition by net_id order by {_LINE}) - 1 as k")
    s = k.select(
        "net_id", "k", (F.col("k") % 2).cast("int").alias("thread"), F.floor(F.col("k") / 2).cast("int").alias("j"), (F.col("l_suppkey") % 3).cast("int").alias("lock"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_partkey") % 4).cast("string").alias("var"), F.element_at(F.array(*[F.lit(o) for o in ORDERINGS]), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("ordering"), F.concat_ws(":", F.col("l_partkey"), F.col("l_suppkey")).alias("span"),
    )
    s = s.selectExpr("*", "flag = 'N' and row_number() over (partition by net_id, thread, lock, flag order by j) = 1 as takes")
    s = s.selectExpr("*", "cast(count_if(thread = 0) over (partition by net_id) as int) as n0", "cast(count_if(thread = 1) over (partition by net_id) as int) as n1")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderkey").cast("string").alias("net_id")).agg(F.min("o_orderstatus").alias("of_status"), (F.min("o_orderpriority") == "5-LOW").alias("again"))
    return orders.join(s, "net_id", "left").na.fill(0, ["n0", "n1"])


def nets(spark: SparkSession, sf_dir: str, special: bool = False, ticking: bool = False, staged: bool = True) -> Net:
    """The nets of all orders: each table is what the rows of ``order_rows`` give by themselves.

    Without ``staged`` the rows are not written first, so a query that reads one table once finds them dealt by net."""
    join_by_size(spark)
    rows = stage(order_rows(spark, sf_dir), "order-rows") if staged else order_rows(spark, sf_dir)
    c, none, text, number = F.col, F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("int")
    # the first row of an order and the first one of a thread also give what belongs to the order or thread
    of_order, of_thread, of_step = c("k").isNull() | (c("k") == 0), c("j") == 0, c("k").isNotNull()
    second = c("thread") == 1
    n, at, t0 = F.when(second, c("n1")).otherwise(c("n0")), F.when(second, 8 + c("n0")).otherwise(6), F.when(second, 3 + c("n0")).otherwise(2)
    emit = lambda *some: rows.select("net_id", F.inline(F.filter(F.array(*some), lambda a: a.isNotNull())))
    # places: 0 to 5 of the order, then of each thread one before each step, one after the last and one when it is done
    place = lambda when, p, name, tokens, capacity, kind: F.when(when, F.struct(p.cast("int").alias("place_id"), name.alias("name"), tokens.cast("long").alias("tokens"), capacity.cast("long").alias("capacity"), F.lit(kind).alias("place_type"), F.lit("").alias("span")))
    begins = c("of_status") == "O"
    fixed = [("main_start", begins, 1, "FunctionStart"), ("main_end", F.lit(0), 1, "FunctionEnd"), ("main_wait", ~begins, None, "BasicBlock")] + [(f"lock_{i}", F.lit(1), 1, "Resources") for i in range(3)]
    named = lambda *parts: F.concat(F.lit("t"), c("thread").cast("string"), *parts)
    spot = lambda when, j, name, tokens: place(when, at + j, named(F.lit("_"), name), tokens, none, "BasicBlock")
    spots = [spot(of_step, c("j"), c("j").cast("string"), of_thread & ~begins), spot(of_thread, n, n.cast("string"), F.lit(0)), spot(of_thread, n + 1, F.lit("done"), F.lit(0))]
    some_places = [place(of_order, F.lit(i), F.lit(name), t, F.lit(most), kind) for i, (name, t, most, kind) in enumerate(fixed)] + spots
    # transitions: spawn, join, then of each thread its steps and the one that gives its locks back
    returns = (c("flag") == "N") & ~c("takes") & (c("of_status") == "P")
    kind = F.when(c("flag") == "N", F.when(c("takes"), "Lock").when(returns, "Unlock").otherwise("Goto")).when(c("flag") == "R", F.when(c("status") == "O", "UnsafeWrite").otherwise("UnsafeRead")).otherwise(F.when(c("status") == "O", "AtomicStore").otherwise("AtomicLoad"))
    trans = lambda when, t, name, ttype, res=number, var=text, ordering=text, span=F.lit(""), tid=number, block=F.lit(0), data=text: F.when(when, F.struct(t.cast("int").alias("trans_id"), name.alias("name"), ttype.alias("ttype"), res.cast("int").alias("res_place"), var.alias("var"), ordering.alias("ordering"), span.alias("span"), tid.cast("int").alias("tid"), block.cast("int").alias("basic_block"), data.alias("data_type")))
    step = trans(of_step, t0 + c("j"), named(F.lit("_step"), c("j").cast("string")), kind, F.when(c("takes"), 3 + c("lock")), F.when(c("flag") != "N", c("var")), F.when(c("flag") == "A", c("ordering")), c("span"), c("thread"), c("j"), F.when(c("flag") != "N", "i32"))
    some_transitions = [step, trans(of_order, F.lit(0), F.lit("spawn"), F.lit("Spawn")), trans(of_order, F.lit(1), F.lit("join"), F.lit("Join")), trans(of_thread, t0 + n, named(F.lit("_free")), F.lit("Unlock"), tid=c("thread"))]
    arc = lambda when, p, t, way: F.when(when, F.struct(p.cast("int").alias("place_id"), t.cast("int").alias("trans_id"), F.lit(way).alias("direction"), F.lit(1).cast("long").alias("weight")))
    spawn, join, wait = F.lit(0), F.lit(1), F.lit(2)
    end, after = at + n + 1, F.when(c("again") & ~second, at).otherwise(at + n + 1)
    lock, here, move, back = 3 + c("lock"), at + c("j"), t0 + c("j"), t0 + n
    some_arcs = [
        arc(of_order, F.lit(0), spawn, "in"), arc(of_order, wait, spawn, "out"), arc(of_order, wait, join, "in"), arc(of_order, F.lit(1), join, "out"),
        arc(of_thread, at, spawn, "out"), arc(of_thread, end, join, "in"), arc(of_thread, at + n, back, "in"), arc(of_thread, after, back, "out"),
        arc(of_step, here, move, "in"), arc(of_step, here + 1, move, "out"), arc(of_step & c("takes"), lock, move, "in"), arc(of_step & returns, lock, move, "out"), arc(of_step & c("takes") & ~(c("again") & second), lock, back, "out"),
    ]
    if special:
        unsafe = lambda status: of_step & (c("flag") == "R") & (c("status") == status)
        some_arcs += [arc(unsafe("F"), lock, move, "inhibitor"), arc(unsafe("O"), lock, move, "reset")]
    if ticking:
        own = lambda name, more: F.when(c(name) > 0, c(name) + more).otherwise(0)
        log, tick, ticks = 6 + own("n0", 2) + own("n1", 2), 2 + own("n0", 1) + own("n1", 1), of_order & (c("of_status") == "P")
        some_places.append(place(ticks, log, F.lit("log"), F.lit(0), none, "BasicBlock"))
        some_transitions.append(trans(ticks, tick, F.lit("tick"), F.lit("Goto")))
        some_arcs += [arc(ticks, wait, tick, "in"), arc(ticks, wait, tick, "out"), arc(ticks, log, tick, "out")]
    return Net(emit(*some_places), emit(*some_transitions), emit(*some_arcs))


_ORDERING = "([" + ", ".join(f"'{o}'" for o in ORDERINGS) + "])"


def sql(special: bool = False, ticking: bool = False) -> str:
    """Common table expressions of the same rows: places, transitions, arcs, weights, and the dense forms initial and firing."""
    more_arcs = """
  UNION ALL SELECT net_id, 3 + lock, t0 + j, 'inhibitor', 1 FROM placed WHERE flag = 'R' AND status = 'F' UNION ALL SELECT net_id, 3 + lock, t0 + j, 'reset', 1 FROM placed WHERE flag = 'R' AND status = 'O'""" if special else ""
    more_places = more_transitions = ticks = ""
    if ticking:
        ticks = "ticks AS (SELECT net_id, CAST(6 + CASE WHEN n0 > 0 THEN n0 + 2 ELSE 0 END + CASE WHEN n1 > 0 THEN n1 + 2 ELSE 0 END AS INTEGER) AS log, CAST(2 + CASE WHEN n0 > 0 THEN n0 + 1 ELSE 0 END + CASE WHEN n1 > 0 THEN n1 + 1 ELSE 0 END AS INTEGER) AS tick FROM every WHERE of_status = 'P'),\n"
        more_places = "\n  UNION ALL SELECT net_id, log, 'log', 0, NULL, 'BasicBlock', '' FROM ticks"
        more_transitions = "\n  UNION ALL SELECT net_id, tick, 'tick', 'Goto', NULL, NULL, NULL, '', NULL, 0, NULL FROM ticks"
        more_arcs += "\n  UNION ALL SELECT net_id, 2, tick, 'in', 1 FROM ticks UNION ALL SELECT net_id, 2, tick, 'out', 1 FROM ticks UNION ALL SELECT net_id, log, tick, 'out', 1 FROM ticks"
    return f"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS k FROM lineitem),
step0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS net_id, CAST(k % 2 AS INTEGER) AS thread, CAST(k // 2 AS INTEGER) AS j, CAST(l_suppkey % 3 AS INTEGER) AS lock, l_returnflag AS flag, l_linestatus AS status, CAST(l_partkey % 4 AS VARCHAR) AS var, {_ORDERING}[CAST(l_suppkey % 5 + 1 AS INTEGER)] AS ordering, l_partkey || ':' || l_suppkey AS span FROM li),
step AS (SELECT *, flag = 'N' AND row_number() OVER (PARTITION BY net_id, thread, lock, flag ORDER BY j) = 1 AS takes FROM step0),
every AS (SELECT o.net_id, of_status, again, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM (SELECT CAST(o_orderkey AS VARCHAR) AS net_id, min(o_orderstatus) AS of_status, min(o_orderpriority) = '5-LOW' AS again FROM orders GROUP BY 1) o LEFT JOIN (SELECT net_id, CAST(count(*) FILTER (thread = 0) AS INTEGER) AS n0, CAST(count(*) FILTER (thread = 1) AS INTEGER) AS n1 FROM step GROUP BY net_id) USING (net_id)),
{ticks}threads AS (SELECT net_id, of_status, again, 0 AS thread, n0 AS n, 6 AS base, 2 AS t0 FROM every WHERE n0 > 0 UNION ALL SELECT net_id, of_status, again, 1, n1, 8 + n0, 3 + n0 FROM every WHERE n1 > 0),
places AS (
  SELECT net_id, v.place_id, v.name, CASE v.place_id WHEN 0 THEN CAST(of_status = 'O' AS INTEGER) WHEN 2 THEN CAST(of_status <> 'O' AS INTEGER) ELSE v.tokens END AS tokens, v.capacity, v.place_type, '' AS span FROM every, (VALUES (0, 'main_start', 1, 1, 'FunctionStart'), (1, 'main_end', 0, 1, 'FunctionEnd'), (2, 'main_wait', 0, NULL, 'BasicBlock'), (3, 'lock_0', 1, 1, 'Resources'), (4, 'lock_1', 1, 1, 'Resources'), (5, 'lock_2', 1, 1, 'Resources')) v(place_id, name, tokens, capacity, place_type)
  UNION ALL SELECT net_id, CAST(base + j AS INTEGER), 't' || thread || '_' || CASE WHEN j > n THEN 'done' ELSE CAST(j AS VARCHAR) END, CAST(j = 0 AND of_status <> 'O' AS INTEGER), NULL, 'BasicBlock', '' FROM (SELECT *, unnest(range(n + 2)) AS j FROM threads){more_places}),
transitions AS (
  SELECT s.net_id, CAST(t0 + j AS INTEGER) AS trans_id, 't' || s.thread || '_step' || j AS name, CASE flag WHEN 'N' THEN CASE WHEN takes THEN 'Lock' WHEN of_status = 'P' THEN 'Unlock' ELSE 'Goto' END WHEN 'R' THEN CASE status WHEN 'O' THEN 'UnsafeWrite' ELSE 'UnsafeRead' END ELSE CASE status WHEN 'O' THEN 'AtomicStore' ELSE 'AtomicLoad' END END AS ttype,
    CASE WHEN takes THEN 3 + lock END AS res_place, CASE WHEN flag <> 'N' THEN var END AS var, CASE WHEN flag = 'A' THEN ordering END AS ordering, span, s.thread AS tid, j AS basic_block, CASE WHEN flag <> 'N' THEN 'i32' END AS data_type
  FROM step s JOIN threads USING (net_id, thread)
  UNION ALL SELECT net_id, v.trans_id, v.name, v.ttype, NULL, NULL, NULL, '', NULL, 0, NULL FROM every, (VALUES (0, 'spawn', 'Spawn'), (1, 'join', 'Join')) v(trans_id, name, ttype)
  UNION ALL SELECT net_id, CAST(t0 + n AS INTEGER), 't' || thread || '_free', 'Unlock', NULL, NULL, NULL, '', thread, 0, NULL FROM threads{more_transitions}),
placed AS (SELECT s.net_id, s.thread, of_status, again, flag, status, base, t0, n, j, lock, takes FROM step s JOIN threads USING (net_id, thread)),
arcs AS (
  SELECT net_id, v.place_id, v.trans_id, v.direction, 1 AS weight FROM every, (VALUES (0, 0, 'in'), (2, 0, 'out'), (2, 1, 'in'), (1, 1, 'out')) v(place_id, trans_id, direction)
  UNION ALL SELECT net_id, base, 0, 'out', 1 FROM threads UNION ALL SELECT net_id, base + n + 1, 1, 'in', 1 FROM threads
  UNION ALL SELECT net_id, base + j, t0 + j, 'in', 1 FROM placed UNION ALL SELECT net_id, base + j + 1, t0 + j, 'out', 1 FROM placed UNION ALL SELECT net_id, 3 + lock, t0 + j, 'in', 1 FROM placed WHERE takes
  UNION ALL SELECT net_id, base + n, t0 + n, 'in', 1 FROM threads UNION ALL SELECT net_id, CASE WHEN again AND thread = 0 THEN base ELSE base + n + 1 END, t0 + n, 'out', 1 FROM threads UNION ALL SELECT net_id, 3 + lock, t0 + n, 'out', 1 FROM placed WHERE takes AND NOT (again AND thread = 1)
  UNION ALL SELECT net_id, 3 + lock, t0 + j, 'out', 1 FROM placed WHERE flag = 'N' AND NOT takes AND of_status = 'P'{more_arcs}),
weights AS (SELECT net_id, CAST(place_id AS INTEGER) AS place_id, CAST(trans_id AS INTEGER) AS trans_id, direction, CAST(sum(weight) AS BIGINT) AS weight FROM arcs WHERE weight > 0 GROUP BY ALL),
{DENSE}"""
