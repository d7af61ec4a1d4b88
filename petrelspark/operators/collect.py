"""From a program's locals, call sites and statements to the facts that ``translate`` takes.

Inputs, all with net_id and func: locals (local, ty), call sites (bb, target, name, args, dest, span; ``name`` is the callee's
path, null for a function pointer), statements (bb, seq, local, deref, raw, write, span), functions.  Each collector is one
projection of its own table; what belongs together is found by equi-joins on (net_id, func, local).

A local stands for a resource by ``owners`` (net_id, func, local, res), which comes from alias groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.functions import classify as C
from petrelspark.operators.closure import reachable

HERE = ["net_id", "func"]


def lock_guards(local_types: DataFrame) -> DataFrame:
    """(net_id, func, local, maker, kind): the locals that hold a lock's guard; kind is mutex, read or write."""
    guard = C.lock_guard(F.col("ty"))
    kind = F.when(guard.endswith("Mutex"), "mutex").when(guard.endswith("Read"), "read").when(guard.endswith("Write"), "write")
    return local_types.select(*HERE, "local", F.regexp_replace(guard, "(Mutex|Read|Write)$", "").alias("maker"), kind.alias("kind")).where("kind is not null")


def condvars(local_types: DataFrame) -> DataFrame:
    """(net_id, func, local) of condition variables."""
    head = F.substring_index("ty", "<", 1)
    return local_types.where(head.contains("Condvar") & ~C.has_any(head, C.FOREIGN_RUNTIMES)).select(*HERE, "local")


def channel_ends(local_types: DataFrame) -> DataFrame:
    """(net_id, func, local, kind, data): endpoints of channels with the type that they carry."""
    kind = C.channel_endpoint(F.col("ty"))
    data = F.regexp_extract("ty", "<(.*)>$", 1)
    return local_types.select(*HERE, "local", kind.alias("kind"), data.alias("data")).where("kind is not null")


def atomic_operations(sites: DataFrame) -> DataFrame:
    """(net_id, func, bb, local, op, ordering, span): calls on atomic variables; ordering is the name in the argument that holds it, else the strictest."""
    api = C.atomic_api(F.col("name"))
    at = C.ordering_argument(F.col("name"), F.size("args"))
    named = F.substring_index(F.try_element_at("args", at + 1), "::", -1)
    ordering = F.when(named.isin(*C.ORDERINGS), named).otherwise("SeqCst")
    ops = sites.where(F.lower("name").contains("atomic")).select(*HERE, "bb", C.local_of(F.try_element_at("args", F.lit(1))).alias("local"), api.alias("op"), ordering.alias("ordering"), "span")
    return ops.where("op is not null")


def atomic_variables(ops: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(net_id, func, local, operations, ordering): each variable's operations in order; its ordering is that of the first, Relaxed without one."""
    by = F.struct(*(order or ["bb", "span"]))
    done = F.array_sort(F.collect_list(F.struct(by.alias("at"), "op", "span"))).alias("o")
    g = ops.groupBy(*HERE, "local").agg(done, F.min_by("ordering", by).alias("ordering"))
    return g.select(*HERE, "local", F.transform("o", lambda x: F.concat_ws("@", x["op"], x["span"])).alias("operations"), F.coalesce("ordering", F.lit("Relaxed")).alias("ordering"))


def unsafe_accesses(statements: DataFrame) -> DataFrame:
    """(net_id, func, bb, seq, local, action, span): reads and writes through raw pointers."""
    return statements.where("raw and deref").select(*HERE, "bb", "seq", "local", F.when(F.col("write"), "unsafe_write").otherwise("unsafe_read").alias("action"), "span")


def unsafe_blocks(accesses: DataFrame) -> DataFrame:
    """(net_id, func, bb, spans): where each block accesses memory through raw pointers."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "span")))
    return accesses.groupBy(*HERE, "bb").agg(rows.alias("s")).select(*HERE, "bb", F.transform("s", lambda x: x["span"]).alias("spans"))


def closures(local_types: DataFrame) -> DataFrame:
    """(net_id, func, local, callee): what a local whose type is a closure or a function item runs, ``{closure@path}`` or ``fn(..) {path}``."""
    path = F.regexp_extract("ty", r"\{(?:closure@)?([^{}]+)\}\s*$", 1)
    return local_types.select(*HERE, "local", F.nullif(path, F.lit("")).alias("callee")).where("callee is not null")


def spawned_by(sites: DataFrame, local_types: DataFrame) -> DataFrame:
    """(net_id, func, bb, callees): the closures among each call's arguments, in order; a path that stands as an argument is its own."""
    args = sites.select(*HERE, "bb", F.posexplode("args").alias("pos", "arg")).withColumn("local", C.local_of(F.col("arg")))
    known = closures(local_types).withColumnRenamed("callee", "of_type")
    found = args.join(known, [*HERE, "local"], "left").withColumn("callee", F.coalesce("of_type", F.when(F.col("arg").startswith("const "), F.substring("arg", 7, 10_000)))).where("callee is not null")
    return found.groupBy(*HERE, "bb").agg(F.array_sort(F.collect_list(F.struct("pos", "callee"))).alias("c")).select(*HERE, "bb", F.transform("c", lambda x: x["callee"]).alias("callees"))


def dispatched(sites: DataFrame, local_types: DataFrame, owners: DataFrame, functions: DataFrame, handles: DataFrame | None = None, blocks: DataFrame | None = None, semantics: str = "strict") -> DataFrame:
    """The call facts of ``translate``: (net_id, func, bb, target, action, callee, callees, res, res2, ordering, span, tid).

    The first that holds: a call that goes on in a cleanup block of ``blocks`` (net_id, func, bb, is_cleanup) is a panic; a call whose destination is a guard
    is a lock, whatever its name (in compiled programs the guard comes from the ``unwrap`` of what ``lock`` gives); then a condition
    variable's call, a drop of a guard, a channel's, a thread's or an atomic variable's call, a panic, a call of a known function or else of a known
    closure among its arguments.  All else, function pointers included, only goes on, or is a panic if it never returns.  A guard that is
    handed on (an argument is a guard, or what a condition variable's wait gave) is not locked again; compat locks it.

    A join waits for what the spawn into its argument started, or for what ``handles`` (net_id, func, local, callee) says, such as
    the handles that ``translate.handle_flow`` follows."""
    guards = lock_guards(local_types).select(*HERE, "local", F.col("kind").alias("guard"))
    of = lambda d, key, *names: d.select(*HERE, F.col("local").alias(key), *[F.col(x).alias(f"{key}_{x}") for x in names])
    s = sites.withColumns({"arg0": C.local_of(F.try_element_at("args", F.lit(1))), "arg1": C.local_of(F.try_element_at("args", F.lit(2)))})
    s = s.join(of(guards, "dest", "guard"), [*HERE, "dest"], "left").join(of(guards, "arg0", "guard"), [*HERE, "arg0"], "left")
    for key in ("dest", "arg0", "arg1"):
        s = s.join(of(owners, key, "res"), [*HERE, key], "left")
    sync, thread, api = C.synchronization(F.col("name")), C.thread_control(F.col("name")), C.atomic_api(F.col("name"))
    waited = sites.where(C.synchronization(F.col("name")) == "condvar_wait").select(*HERE, F.col("dest").alias("arg0"), F.lit(True).alias("waited")).where("arg0 is not null").distinct()
    s = s.join(waited, [*HERE, "arg0"], "left")
    known = functions.select("net_id", F.col("func").alias("name"), F.lit(True).alias("known")).distinct()
    s = s.join(known, ["net_id", "name"], "left").join(spawned_by(sites, local_types), [*HERE, "bb"], "left").withColumn("first", F.try_element_at("callees", F.lit(1)))
    s = s.join(known.select("net_id", F.col("name").alias("first"), F.col("known").alias("runs")), ["net_id", "first"], "left")
    if blocks is not None:
        cleanup = blocks.where("is_cleanup").select(*HERE, F.col("bb").alias("target"), F.lit(True).alias("unwinds")).distinct()
        s = s.join(cleanup, [*HERE, "target"], "left")
    release = F.concat(F.lit("unlock_"), F.col("arg0_guard"))
    atomic = F.when(F.lower("name").contains("atomic"), F.when(api == "read", "atomic_load").when(api == "write", "atomic_store").when(api == "read_write", "atomic_cas"))
    handed_on = F.lit(semantics != "compat") & (F.col("arg0_guard").isNotNull() | F.col("waited").isNotNull() | F.coalesce(sync == "condvar_wait", F.lit(False)))
    takes = F.when(~handed_on, F.concat("dest_guard", F.lit("_lock")))
    goes_on = F.when(F.col("target").isNull(), "panic").otherwise("plain")
    panics = F.when(F.col("unwinds"), "panic") if blocks is not None else F.lit(None).cast("string")
    action = F.coalesce(
        panics, takes,
        F.when(sync == "condvar_notify", "notify").when(sync == "condvar_wait", "wait"),
        F.when(F.col("name").contains("::drop"), F.coalesce(release, F.lit("plain"))),
        F.when(sync == "channel_send", "send").when(sync == "channel_recv", "recv"),
        thread, atomic,
        F.when(F.col("name").contains("core::panic"), "panic"),
        F.when(F.coalesce("known", "runs"), "normal"),
        goes_on,
    )
    s = s.withColumn("action", F.when(F.col("name").isNull(), F.coalesce(panics, takes, goes_on)).otherwise(action))
    res = F.when(F.col("action").endswith("_lock"), F.col("dest_res")).when(~F.col("action").isin("plain", "panic"), F.col("arg0_res"))
    started = F.col("action").isin("spawn", "scope_spawn", "async_spawn")
    own = s.where(started & F.col("dest").isNotNull()).select(*HERE, F.col("dest").alias("arg0"), F.col("first").alias("waits"))
    if handles is not None:
        own = own.unionByName(handles.select(*HERE, F.col("local").alias("arg0"), F.col("callee").alias("waits")))
    s = s.join(own.groupBy(*HERE, "arg0").agg(F.min("waits").alias("waits")), [*HERE, "arg0"], "left")
    called = F.when(F.col("known"), F.col("name")).otherwise(F.col("first"))
    joins = F.col("action").isin("join", "scope_join", "async_join")
    one = F.when(F.col("action") == "normal", called).when(started, F.col("first")).when(joins, F.col("waits"))
    out = s.join(atomic_operations(sites).select(*HERE, "bb", "ordering"), [*HERE, "bb"], "left")
    several = F.when(F.col("action") == "rayon_join", F.col("callees")).alias("callees")
    res2 = F.when(F.col("action") == "wait", F.col("arg1_res")).alias("res2")
    return out.select(*HERE, "bb", "target", "action", one.alias("callee"), several, res.alias("res"), res2, "ordering", "span", F.lit(0).alias("tid"))


def call_sites(sites: DataFrame, local_types: DataFrame, functions: DataFrame) -> DataFrame:
    """Call edges (net_id, caller, callee, site_kind, location, dest): direct calls of known functions, closures that a local holds, and what thread control starts."""
    known = functions.select("net_id", F.col("func").alias("name")).distinct()
    direct = sites.join(known, ["net_id", "name"]).select("net_id", F.col("func").alias("caller"), F.col("name").alias("callee"), F.lit("direct").alias("site_kind"), F.concat(F.lit("bb"), F.col("bb").cast("string")).alias("location"), "dest")
    held = closures(local_types).select("net_id", F.col("func").alias("caller"), "callee", F.lit("closure_def").alias("site_kind"), F.col("local").alias("location"), F.lit(None).cast("string").alias("dest"))
    kind = C.thread_control(F.col("name"))
    started = sites.withColumn("kind", kind).where("kind in ('spawn', 'scope_spawn', 'async_spawn', 'rayon_join')").join(spawned_by(sites, local_types), [*HERE, "bb"])
    started = started.select("net_id", F.col("func").alias("caller"), F.explode("callees").alias("callee"), F.col("kind").alias("site_kind"), F.concat(F.lit("bb"), F.col("bb").cast("string")).alias("location"), "dest")
    return direct.unionByName(held).unionByName(started)


def closure_upvars(edges: DataFrame) -> DataFrame:
    """(net_id, closure, func, local): where each closure is made, and the local that holds what it captures."""
    return edges.where("site_kind = 'closure_def'").select("net_id", F.col("callee").alias("closure"), F.col("caller").alias("func"), F.col("location").alias("local"))


def needed(functions: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(net_id, func): the functions that call edges (net_id, caller, callee) lead to from the entries, and from ``roots`` (net_id, func), such as
    those that use locks, condition variables, atomics or channels."""
    start = functions.where("is_entry").select("net_id", "func")
    start = (start if roots is None else start.union(roots.select("net_id", "func"))).select("net_id", F.col("func").alias("root"), F.col("func").alias("node"))
    to = reachable(edges.select("net_id", F.col("caller").alias("src"), F.col("callee").alias("dst")), start, ["net_id"])
    return to.select("net_id", F.col("node").alias("func")).distinct().join(functions.select("net_id", "func"), ["net_id", "func"], "left_semi")


def serialization(name: Column) -> Column:
    """Calls that translation skips."""
    return C.has_any(name, C.SERIALIZATION)


def access_pattern(place: Column, referenced: Column) -> Column:
    """direct, ref, indirect or constant: how a place such as ``(*_1).0``, ``_1.0`` or ``const 1`` is used."""
    return F.when(place.startswith("const"), "constant").when(referenced, "ref").when(place.startswith("(*"), "indirect").otherwise("direct")


def projections_may_meet(a: Column, b: Column) -> Column:
    """If two projections of the same length may name one element: an index or a subslice meets any element, constant indices only their own, and all else itself."""
    is_const = lambda x: x.startswith("const[")
    is_open = lambda x: x.startswith("index[") | x.startswith("subslice[")
    element = lambda x: is_const(x) | is_open(x)
    both = F.zip_with(a, b, lambda x, y: (x == y) | (element(x) & element(y) & (is_open(x) | is_open(y))))
    return (F.size(a) == F.size(b)) & F.forall(both, lambda x: F.coalesce(x, F.lit(False)))


def atomic_aliases(pts: DataFrame, pairs: DataFrame, max_depth: int = 20) -> DataFrame:
    """``pairs`` (func, a, b) with ``kind``: Probably if what leads to one of the two and what leads to the other meet, or one leads to the other; else Unlikely.

    Locals lead to each other through points-to facts (func, node, target), ``max_depth`` steps at most."""
    local = lambda c: F.substring_index(F.regexp_extract(c, r"^(?:Alloc\()?([^()]*)\)?$", 1), ".", 1)
    back = pts.select("func", local("target").alias("src"), local("node").alias("dst")).where("src != dst").distinct()
    ends = pairs.select("func", F.explode(F.array("a", "b")).alias("root")).distinct()
    to = reachable(back, ends.select("func", "root", local("root").alias("node")), ["func"], max_depth, partial=True).select("func", "root", "node")
    x, y = to.withColumnRenamed("root", "a"), to.withColumnRenamed("root", "b")
    meets = pairs.select("func", "a", "b").distinct().join(x, ["func", "a"]).join(y, ["func", "b", "node"], "left_semi").select("func", "a", "b").distinct().withColumn("meets", F.lit(True))
    return pairs.join(meets, ["func", "a", "b"], "left").select("func", "a", "b", F.when(F.col("meets"), "Probably").otherwise("Unlikely").alias("kind"))


def parameter_paths(pts: DataFrame, nodes: DataFrame, parameters: DataFrame, max_length: int = 20) -> DataFrame:
    """(func, root, path): ways from a node (func, node) to a parameter (func, local) through pointees that are fields of a local, as ``local:projection`` steps."""
    from petrelspark.staging import settle

    head = lambda c: F.substring_index(c, ".", 1)
    bare = F.regexp_extract("target", r"^(?:Alloc\()?([^()]*)\)?$", 1)
    step = settle(pts.select("func", F.col("node").alias("at"), bare.alias("to")).where(F.col("to").contains(".")).select("func", "at", head("to").alias("next"), F.expr("substring(to, instr(to, '.') + 1)").alias("proj")).distinct())
    goal = parameters.select("func", F.col("local").alias("param")).distinct()
    front = settle(nodes.select("func", F.col("node").alias("root"), F.col("node").alias("at"), F.array("node").alias("seen"), F.array(F.concat(F.col("node"), F.lit(":"))).alias("path")).distinct())
    out = None
    for _ in range(max_length):
        hit = front.join(goal, (front["func"] == goal["func"]) & (head("at") == F.col("param")), "left_semi").select("func", "root", "path")
        out = hit if out is None else out.union(hit)
        on = front.join(goal, (front["func"] == goal["func"]) & (head("at") == F.col("param")), "left_anti")
        front = settle(on.join(step, ["func", "at"]).where(~F.array_contains("seen", F.col("next"))).select("func", "root", F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"), F.concat("path", F.array(F.concat_ws(":", "next", "proj"))).alias("path")))
        if front.isEmpty():
            break
    return out


def segments(calls: DataFrame) -> DataFrame:
    """Net rows of the places that order a thread's atomic operations (net_id, func, bb, action, ordering, tid): a chain of segments for each
    thread, on which a Relaxed operation stays and any other goes on to the next; SeqCst ones also share one place."""
    from petrelspark.operators.translate import _arc, _emit, _p, _place

    ops = calls.where("action in ('atomic_load', 'atomic_store', 'atomic_cas')").withColumn("ordering", F.coalesce("ordering", F.lit("Relaxed")))
    before = Window.partitionBy("net_id", "tid").orderBy("func", "bb").rowsBetween(Window.unboundedPreceding, -1)
    moves = (F.col("ordering") != "Relaxed").cast("int")
    ops = ops.withColumn("seg", F.coalesce(F.sum(moves).over(before), F.lit(0))).withColumn("moves", moves)
    n, t = F.col("net_id"), _p(F.col("func"), "_bb", F.col("bb").cast("string"), "_", F.col("action"))
    seg = lambda k: _p("seg_t", F.col("tid").cast("string"), "_s", k.cast("string"))
    here, there = seg(F.col("seg")), seg(F.col("seg") + F.col("moves"))
    none = F.lit(None)
    out = _emit(ops, _place(n, here, F.when(F.col("seg") == 0, 1).otherwise(0), none), _place(n, there, F.when(F.col("seg") + F.col("moves") == 0, 1).otherwise(0), none), _arc(n, here, t), _arc(n, t, there))
    strict = ops.where("ordering = 'SeqCst'")
    one = F.lit("SeqCst_Global")
    return out.union(_emit(strict, _place(n, one, 1, none, "Resources"), _arc(n, one, t), _arc(n, t, one)))


def block_chain(accesses: DataFrame) -> DataFrame:
    """Net rows of what a block does before its terminator: each access (net_id, func, bb, seq, action, res, span, tid) is a transition from the block's last place to a new one.

    The rows of ``translate`` for a terminator start from the place that ``chain_end`` names."""
    from petrelspark.operators.translate import _arc, _emit, _p, _place, _trans

    w = Window.partitionBy("net_id", "func", "bb").orderBy("seq")
    d = accesses.withColumn("k", F.row_number().over(w))
    n, base = F.col("net_id"), _p(F.col("func"), "_bb", F.col("bb").cast("string"))
    at = F.when(F.col("k") == 1, base).otherwise(_p(base, "_", (F.col("k") - 1).cast("string")))
    to, t = _p(base, "_", F.col("k").cast("string")), _p(base, "_", F.col("k").cast("string"), "_", F.col("action"))
    label = F.when(F.col("action") == "unsafe_write", "UnsafeWrite").otherwise("UnsafeRead")
    return _emit(d, _place(n, to), _trans(n, t, label, res=F.col("res"), var=F.col("res"), span=F.col("span"), thread=F.col("tid")), _arc(n, at, t), _arc(n, t, to), _arc(n, F.col("res"), t), _arc(n, t, F.col("res")))


def chain_end(accesses: DataFrame) -> DataFrame:
    """(net_id, func, bb, last): the place from which the terminator of a block with accesses starts."""
    g = accesses.groupBy("net_id", "func", "bb").agg(F.count("*").alias("k"))
    return g.select("net_id", "func", "bb", F.concat("func", F.lit("_bb"), F.col("bb").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("last"))
