"""Program facts to nets: one rule for each kind of terminator, call and resource, as projections that emit net rows.

Facts (all with ``func``): functions, blocks, calls, resources and aliases as tables; a fact's row gives some places, transitions and
arcs with text ids, which ``as_net`` numbers.  Every rule only reads its own table, and the rows of all rules are united and added up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.plans.net import Net
from petrelspark.staging import FEW, counted, stage

ROWS = "net_id string, kind string, id string, other string, tokens long, capacity long, ptype string, ttype string, res string, var string, ordering string, span string, tid int"


def _place(net: Column, pid: Column, tokens=0, capacity=1, ptype: str = "BasicBlock") -> Column:
    return _row(net, "place", pid, tokens=tokens, capacity=capacity, ptype=F.lit(ptype))


def _trans(net: Column, tid: Column, ttype, res: Column | None = None, var: Column | None = None, ordering: Column | None = None, span: Column | None = None, thread: Column | None = None) -> Column:
    return _row(net, "transition", tid, ttype=ttype if isinstance(ttype, Column) else F.lit(ttype), res=res, var=var, ordering=ordering, span=span, tid=thread)


def _arc(net: Column, a: Column, b: Column, weight=1) -> Column:
    return _row(net, "arc", a, other=b, tokens=weight)


def _row(net: Column, kind: str, pid: Column, **more) -> Column:
    names = {"other": "string", "tokens": "long", "capacity": "long", "ptype": "string", "ttype": "string", "res": "string", "var": "string", "ordering": "string", "span": "string", "tid": "int"}
    cast = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(net.alias("net_id"), F.lit(kind).alias("kind"), pid.alias("id"), *[cast(more.get(n), t).alias(n) for n, t in names.items()])


def _emit(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _p(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def function_rows(functions: DataFrame) -> DataFrame:
    """Start and end place of each function (net_id, func, is_entry); the entry's start has the token."""
    n, f = F.col("net_id"), F.col("func")
    return _emit(functions, _place(n, _p(f, "_start"), F.when(F.col("is_entry"), 1).otherwise(0), 1, "FunctionStart"), _place(n, _p(f, "_end"), 0, 1, "FunctionEnd"))


def block_rows(blocks: DataFrame) -> DataFrame:
    """A place for each block (net_id, func, bb, is_cleanup, is_empty_unreachable), and the start of the function into block 0; cleanup blocks and empty unreachable ones have none."""
    n, f, at = F.col("net_id"), F.col("func"), _p(F.col("func"), "_bb", F.col("bb").cast("string"))
    some = blocks.where("not coalesce(is_cleanup, false) and not coalesce(is_empty_unreachable, false)")
    t = _p(f, "_enter")
    return _emit(some, _place(n, at)).union(_emit(some.where("bb = 0"), _trans(n, t, "Start", var=f), _arc(n, _p(f, "_start"), t), _arc(n, t, at)))


#: Terminators that go to each of their targets, and those that end the function.
FLOW = {"goto": "Goto", "false_edge": "Goto", "false_unwind": "Goto", "yield": "Goto", "inline_asm": "Goto", "switch": "Switch", "assert": "Assert", "drop": "Drop"}
ENDING = ["return", "unreachable", "resume", "terminate", "coroutine_drop", "tail_call"]


def flow_rows(blocks: DataFrame, semantics: str = "strict", entry: str = "main") -> DataFrame:
    """Transitions of terminators that aren't calls.  A return has a transition for each block; compat has one for the function that needs all
    of its return blocks.  Other ends lead to the function's own end; in compat to the entry's."""
    n, f, bb = F.col("net_id"), F.col("func"), F.col("bb").cast("string")
    at = _p(f, "_bb", bb)
    some = blocks.where("not coalesce(is_cleanup, false) and not coalesce(is_empty_unreachable, false)")
    live = some.select("net_id", "func", F.col("bb").alias("to"))
    go = some.where(F.col("term_kind").isin(*FLOW)).select("*", F.explode("targets").alias("to")).join(live, ["net_id", "func", "to"])
    t = _p(f, "_bb", bb, "_to_bb", F.col("to").cast("string"))
    label = reduce(lambda c, kv: c.when(F.col("term_kind") == kv[0], kv[1]), FLOW.items(), F)
    out = _emit(go, _trans(n, t, label, span=F.col("span")), _arc(n, at, t), _arc(n, t, _p(f, "_bb", F.col("to").cast("string"))))
    ends = some.where(F.col("term_kind").isin(*ENDING))
    is_return = F.col("term_kind") == "return"
    shared = F.lit(semantics == "compat") & is_return
    t = F.when(shared, _p(f, "_return")).otherwise(_p(f, "_bb", bb, "_", F.col("term_kind")))
    goal = F.when(F.lit(semantics == "compat") & ~is_return, F.lit(f"{entry}_end")).otherwise(_p(f, "_end"))
    return out.union(_emit(ends, _trans(n, t, F.when(is_return, "Return").otherwise("Goto"), span=F.col("span")), _arc(n, at, t))).union(_emit(ends.select("net_id", "func", t.alias("t"), goal.alias("goal")).distinct(), _arc(n, F.col("t"), F.col("goal"))))


def resource_rows(resources: DataFrame, semantics: str = "strict") -> DataFrame:
    """Places of resources (net_id, res, kind): mutex 1/1, rwlock 10/10, condvar 0/1 (compat: 1/1), channel 0/100, atomic and unsafe 1/1, worker 1/1."""
    tokens = {"mutex": 1, "rwlock": 10, "condvar": 1 if semantics == "compat" else 0, "channel": 0, "atomic": 1, "unsafe": 1, "worker": 1}
    most = {"rwlock": 10, "channel": 100}
    pick = lambda table, other: reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), table.items(), F).otherwise(other)
    return _emit(resources, _place(F.col("net_id"), F.col("res"), pick(tokens, 0), pick(most, 1), "Resources"))


def call_rows(calls: DataFrame, semantics: str = "strict", entry: str = "main") -> DataFrame:
    """Transitions of calls (net_id, func, bb, target, action, callee, callees, res, res2, ordering, span, tid).

    ``action`` is normal, mutex_lock, read_lock, write_lock, unlock_mutex, unlock_read, unlock_write, notify, wait, send, recv, spawn, join, scope_spawn,
    scope_join, rayon_join, async_spawn, async_join, atomic_load, atomic_store, atomic_cas, unsafe_read, unsafe_write, panic or plain; null is plain.  A write lock
    takes and gives 10 (compat: takes 1 and gives 10).  A panic, and a plain call without a target, ends the entry function."""
    n, f = F.col("net_id"), F.col("func")
    at, to = _p(f, "_bb", F.col("bb").cast("string")), _p(f, "_bb", F.col("target").cast("string"))
    # a call that does nothing else and never returns ends the program, as a panic does
    base = calls.withColumn("action", F.coalesce("action", F.lit("plain")))
    base = base.withColumn("action", F.when((F.col("action") == "plain") & F.col("target").isNull(), "panic").otherwise(F.col("action")))
    t = _p(f, "_bb", F.col("bb").cast("string"), "_", F.col("action"))
    res, callee, wait, ret = F.col("res"), F.col("callee"), _p(at, "_waiting"), _p(t, "_ret")
    action = F.col("action")
    about = {"span": F.col("span"), "thread": F.col("tid"), "res": res}
    only = lambda when, *rows: [F.when(when, r) for r in rows]
    rows: list[Column] = []

    def step(actions: list[str], label, takes: list = (), gives: list = (), goes_on: bool = True, **more) -> None:
        """One transition from the call's block, with what it takes and gives besides, and on to the target."""
        when = action.isin(*actions)
        rows.extend(only(when, _trans(n, t, label, **{**about, **more}), _arc(n, at, t), *[_arc(n, p, t, w) for p, w in takes], *[_arc(n, t, p, w) for p, w in gives]))
        if goes_on:
            rows.extend(only(when & F.col("target").isNotNull(), _arc(n, t, to)))

    def waiting(name: str, go: Column, back: Column, out: list, into: list) -> None:
        """Two transitions, with a place between in which the caller waits; ``out`` is given by the first one, ``into`` taken by the second."""
        when = action == name
        rows.extend(only(when, _place(n, wait), go, _arc(n, at, t), _arc(n, t, wait), *[_arc(n, t, p) for p in out], back, _arc(n, wait, ret), *[_arc(n, p, ret) for p in into]))
        rows.extend(only(when & F.col("target").isNotNull(), _arc(n, ret, to)))

    step(["plain"], "Goto")
    step(["panic"], "Panic", gives=[(F.lit(f"{entry}_end"), 1)], goes_on=False, res=None, thread=None)
    step(["mutex_lock"], "Lock", [(res, 1)])
    step(["read_lock"], "RwLockRead", [(res, 1)])
    step(["write_lock"], "RwLockWrite", [(res, 1 if semantics == "compat" else 10)])
    step(["unlock_mutex", "unlock_read"], "Unlock", gives=[(res, 1)])
    step(["unlock_write"], "Unlock", gives=[(res, 10)])
    step(["notify"], "Notify", gives=[(res, 1)])
    step(["send"], "Function", gives=[(res, 1)])
    step(["recv"], "Function", [(res, 1)])
    # a normal call waits for its callee's end; waiting gives the lock back and takes it again with the notification
    waiting("normal", _trans(n, t, "Function", span=F.col("span")), _trans(n, ret, "Function"), [_p(callee, "_start")], [_p(callee, "_end")])
    waiting("wait", _trans(n, t, "Wait", res=res), _trans(n, ret, "Wait", res=res), [F.col("res2")], [res, F.col("res2")])
    # all of several callees start at once, and the join waits for all of their ends
    waiting("rayon_join", _trans(n, t, "Spawn"), _trans(n, ret, "Join"), [], [])
    step(["spawn", "scope_spawn"], "Spawn", gives=[(_p(callee, "_start"), 1)], var=callee)
    step(["join", "scope_join"], "Join", [(_p(callee, "_end"), 1)], var=callee)
    step(["async_spawn"], "AsyncSpawn", gives=[(_p(callee, "_ready"), 1)], var=callee)
    step(["async_join"], "AsyncJoin", [(_p(callee, "_completed"), 1)], var=callee)
    label = F.when(action == "atomic_load", "AtomicLoad").when(action == "atomic_store", "AtomicStore").otherwise("AtomicCmpXchg")
    step(["atomic_load", "atomic_store", "atomic_cas"], label, [(res, 1)], [(res, 1)], var=res, ordering=F.col("ordering"))
    step(["unsafe_read"], "UnsafeRead", [(res, 1)], [(res, 1)], var=res)
    step(["unsafe_write"], "UnsafeWrite", [(res, 1)], [(res, 1)], var=res)
    several = F.when(action == "rayon_join", F.coalesce("callees", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    starts = F.transform(several, lambda c: _arc(n, t, F.concat(c, F.lit("_start"))))
    ends = F.transform(several, lambda c: _arc(n, F.concat(c, F.lit("_end")), ret))
    # one pass over the calls: each row gives the rows of its own action
    return base.select(F.inline(F.concat(F.filter(F.array(*rows), lambda r: r.isNotNull()), starts, ends)))


def task_rows(tasks: DataFrame) -> DataFrame:
    """The life of asynchronous tasks (net_id, task, awaits): ready, running, completed, and the worker that runs one at a time.

    For each of ``awaits`` suspension points the task either goes on, or gives its worker up until an event wakes it."""
    n, k, w = F.col("net_id"), F.col("task"), F.lit("async_worker")
    ready, running, done = _p(k, "_ready"), _p(k, "_running"), _p(k, "_completed")
    poll, end = _p(k, "_poll"), _p(k, "_done")
    out = _emit(tasks, _place(n, ready), _place(n, running), _place(n, done), _trans(n, poll, "AsyncPoll", var=k), _arc(n, ready, poll), _arc(n, w, poll), _arc(n, poll, running), _trans(n, end, "AsyncDone", var=k), _arc(n, running, end), _arc(n, end, done), _arc(n, end, w))
    out = out.union(_emit(tasks.select("net_id").distinct(), _place(n, w, 1, 1, "Resources")))
    each = tasks.where("awaits > 0").select("*", F.explode(F.transform(F.sequence(F.lit(1), F.col("awaits")), lambda x: x.cast("string"))).alias("i"))
    i = F.col("i")
    blocked, event = _p(k, "_blocked", i), _p(k, "_event", i)
    go, stop, wake = _p(k, "_await_ready", i), _p(k, "_await_pending", i), _p(k, "_wake", i)
    return out.union(_emit(each, _place(n, blocked), _place(n, event, 1), _trans(n, go, "AwaitReady", var=k), _arc(n, running, go), _arc(n, event, go), _arc(n, go, running), _trans(n, stop, "AwaitPending", var=k), _arc(n, running, stop), _arc(n, stop, blocked), _arc(n, stop, w), _trans(n, wake, "AsyncWake", var=k), _arc(n, blocked, wake), _arc(n, event, wake), _arc(n, wake, ready)))


def as_net(rows: DataFrame) -> Net:
    """Number the rows of the rules: places and transitions by id within a net.  Arcs whose ends aren't there are left out."""
    w = Window.partitionBy("net_id").orderBy("id")
    p = rows.where("kind = 'place'").groupBy("net_id", "id").agg(F.max("tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.max("ptype").alias("place_type")).withColumn("k", (F.row_number().over(w) - 1).cast("int"))
    t = rows.where("kind = 'transition'").groupBy("net_id", "id").agg(*[F.max(c).alias(c) for c in ("ttype", "res", "var", "ordering", "span", "tid")]).withColumn("k", (F.row_number().over(w) - 1).cast("int"))
    a = rows.where("kind = 'arc'").select("net_id", "id", "other", F.col("tokens").alias("weight"))
    pk, tk = p.select("net_id", F.col("id").alias("pid"), F.col("k").alias("place_id")), t.select("net_id", F.col("id").alias("tid_"), F.col("k").alias("trans_id"))
    side = lambda x, y, way: a.join(pk, (a["net_id"] == pk["net_id"]) & (a[x] == F.col("pid"))).drop(pk["net_id"]).join(tk.withColumnRenamed("net_id", "n2"), (F.col("net_id") == F.col("n2")) & (F.col(y) == F.col("tid_"))).select("net_id", "place_id", "trans_id", F.lit(way).alias("direction"), "weight")
    res = pk.select(F.col("net_id").alias("n3"), F.col("pid").alias("res"), F.col("place_id").alias("res_place"))
    trans = t.join(res, (t["net_id"] == F.col("n3")) & (t["res"] == res["res"]), "left").select("net_id", F.col("k").alias("trans_id"), F.col("id").alias("name"), "ttype", "res_place", "var", "ordering", "span", "tid", F.lit(0).alias("basic_block"), F.lit(None).cast("string").alias("data_type"))
    return Net(p.select("net_id", F.col("k").alias("place_id"), F.col("id").alias("name"), "tokens", "capacity", "place_type", F.lit("").alias("span")), trans, side("id", "other", "in").union(side("other", "id", "out")))


def net_rows(functions: DataFrame, blocks: DataFrame, calls: DataFrame, resources: DataFrame, tasks: DataFrame | None = None, semantics: str = "strict", entry: str = "main") -> DataFrame:
    """The rows of all rules, which ``as_net`` numbers."""
    blocks, calls = counted(blocks, "blocks"), counted(calls, "calls")  # each rule reads them
    rows = function_rows(functions).union(block_rows(blocks)).union(flow_rows(blocks, semantics, entry)).union(call_rows(calls, semantics, entry)).union(resource_rows(resources, semantics))
    return rows.union(task_rows(tasks)) if tasks is not None else rows


def translate(functions: DataFrame, blocks: DataFrame, calls: DataFrame, resources: DataFrame, tasks: DataFrame | None = None, only: DataFrame | None = None, semantics: str = "strict", entry: str = "main") -> Net:
    """The net of a program, or of its functions in ``only`` (net_id, func), such as those that are reachable from the entry."""
    if only is not None:
        functions, blocks, calls = (d.join(only, ["net_id", "func"], "left_semi") for d in (functions, blocks, calls))
    return as_net(counted(net_rows(functions, blocks, calls, resources, tasks, semantics, entry), "net-rows"))


def alike(*facts: DataFrame) -> DataFrame:
    """(net_id, like): every net of the facts, with the least one that has the same facts.

    Facts are told by their number and by sums of two 64-bit hashes of each, so what meets is one row for each net and task.  Nulls, in arrays too,
    are hashed besides the values, as a hash passes over nulls."""
    def hashes(k: int, d: DataFrame) -> DataFrame:
        own = [F.col(c) for c, _ in d.dtypes if c != "net_id"]
        parts = [F.lit(k), *[c.isNull() for c in own], *[F.transform(c, lambda x: x.isNull()) for c, t in d.dtypes if t.startswith("array")], *own]
        return d.select("net_id", F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("g"))

    every = reduce(DataFrame.union, [hashes(k, d) for k, d in enumerate(facts)])
    # the halves of a hash, so that no sum runs over
    low, high = lambda c: F.sum(F.col(c).bitwiseAND(F.lit((1 << 32) - 1))), lambda c: F.sum(F.shiftrightunsigned(c, 32))
    sums = {"n": F.count(F.lit(1)), "h0": low("h"), "h1": high("h"), "g0": low("g"), "g1": high("g")}
    nets = stage(every.groupBy("net_id").agg(*[v.alias(c) for c, v in sums.items()]), "programs")
    least = counted(nets.groupBy(*sums).agg(F.min("net_id").alias("like")), "alike")
    return nets.join(least, list(sums)).select("net_id", "like")


def translate_once(functions: DataFrame, blocks: DataFrame, calls: DataFrame, resources: DataFrame, semantics: str = "strict", entry: str = "main") -> Net:
    """``translate`` for many programs: those with the same facts are translated once, and each gets the rows of its like."""
    facts = functions, blocks, calls, resources
    nets = stage(alike(*facts), "likes")
    first = counted(nets.where("net_id = like").select("net_id"), "firsts")
    rows = counted(net_rows(*[d.join(first, "net_id", "left_semi") for d in facts], semantics=semantics, entry=entry), "net-rows")
    few = rows.count() <= FEW
    made = as_net(rows)

    def dealt(d: DataFrame) -> DataFrame:
        d = d.withColumnRenamed("net_id", "of")
        return nets.join(F.broadcast(d) if few else d, F.col("like") == F.col("of")).drop("like", "of")

    return Net(dealt(made.places), dealt(made.transitions), dealt(made.weights()), added=True)


def channel_pairs(endpoints: DataFrame) -> DataFrame:
    """(site, sender, receiver): declaration sites with exactly two endpoints (site, endpoint, role), one of each role."""
    g = endpoints.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "sender").alias("s"), F.count_if(F.col("role") == "receiver").alias("r"), F.min(F.when(F.col("role") == "sender", F.col("endpoint"))).alias("sender"), F.min(F.when(F.col("role") == "receiver", F.col("endpoint"))).alias("receiver"))
    return g.where("n = 2 and s = 1 and r = 1").select("site", "sender", "receiver")


def fifo_joins(spawns: DataFrame, joins: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th join (ord) of a key with its k-th spawn (ord, callee), for joins whose handle isn't known otherwise."""
    rank = lambda d, name: d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    s = rank(spawns, "k").select(*keys, "k", F.col("ord").alias("spawn_ord"), "callee")
    return rank(joins, "k").select(*keys, "k", F.col("ord").alias("join_ord")).join(s, [*keys, "k"]).drop("k")


def join_callees(joins: DataFrame, by_handle: DataFrame, by_order: DataFrame, by_alias: DataFrame) -> DataFrame:
    """(func, ord, callee): a join's callee by its handle's dataflow, else by program order, else by alias; each table has (func, ord, callee)."""
    out = joins.select("func", "ord")
    for k, d in enumerate((by_handle, by_order, by_alias)):
        out = out.join(d.groupBy("func", "ord").agg(F.min("callee").alias(f"c{k}")), ["func", "ord"], "left")
    return out.select("func", "ord", F.coalesce("c0", "c1", "c2").alias("callee"))


def resource_of(ops: DataFrame, resources: DataFrame, first: bool) -> DataFrame:
    """Operations (op, alias) with the resources (alias, place) of their alias: all of them, or the least."""
    hit = ops.join(resources, "alias", "left")
    return hit.groupBy("op").agg(F.min("place").alias("place")) if first else hit.select("op", "place").distinct()


def lock_groups(links: DataFrame, guards: DataFrame) -> DataFrame:
    """One resource for each group of aliased guards: (component, kind, members, tokens); kind is that of its least guard (guard, kind)."""
    from petrelspark.operators.components import connected_components

    every = links.toDF("a", "b").union(guards.select(F.col("guard"), F.col("guard")))
    c = connected_components(every).join(guards, F.col("node") == F.col("guard"))
    g = c.groupBy("component").agg(F.min_by("kind", "guard").alias("kind"), F.count("*").alias("members"))
    return g.withColumn("tokens", F.when(F.col("kind") == "rwlock", 10).otherwise(1).cast("long"))


def suspension_points(blocks: DataFrame) -> DataFrame:
    """(net_id, func, bb) of the yields."""
    return blocks.where("term_kind = 'yield'").select("net_id", "func", "bb")


def handle_flow(moves: DataFrame, spawned: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(func, local, callee): what a local's join waits for, through moves, references, pushes and iterators (func, src, dst) from the
    handles (func, local, callee)."""
    from petrelspark.staging import settle

    front = found = settle(spawned.select("func", "local", "callee").distinct())
    for _ in range(max_rounds):
        step = front.join(moves.withColumnRenamed("src", "local"), ["func", "local"]).select("func", F.col("dst").alias("local"), "callee").distinct()
        front = settle(step.join(found, ["func", "local", "callee"], "left_anti"))
        if front.isEmpty():
            break
        found = found.union(front)
    return found
