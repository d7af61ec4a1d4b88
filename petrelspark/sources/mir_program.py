"""IR text to whole programs: functions, blocks, typed locals, call sites and what the locals stand for, and from those to a net.

The tables of ``mir`` give lines, blocks and declarations.  Here call sites get their argument lists, closures the function that they run, and locals the resource that
they lead to: places that are copied, moved, borrowed, cloned or handed to a call are joined, fields apart (``_2.0``), and each joined group is one
resource.  ``collect.dispatched`` then says what each call does, and ``translate`` makes the net: spawn, join, locks, channels, condition variables and
atomic variables across all functions of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.operators import collect, translate
from petrelspark.operators.components import connected_components
from petrelspark.plans.net import Net
from petrelspark.sources import mir
from petrelspark.staging import counted

#: Heads of paths that a compiler may print short, and their full form.
FULL = {
    "Mutex": "std::sync::Mutex", "RwLock": "std::sync::RwLock", "Condvar": "std::sync::Condvar", "JoinHandle": "std::thread::JoinHandle", "Sender": "std::sync::mpsc::Sender",
    "SyncSender": "std::sync::mpsc::SyncSender", "Receiver": "std::sync::mpsc::Receiver", "MutexGuard": "std::sync::MutexGuard", "RwLockReadGuard": "std::sync::RwLockReadGuard", "RwLockWriteGuard": "std::sync::RwLockWriteGuard",
}
#: Calls whose result leads to what their first argument leads to.
HANDS_ON = r"::(?:clone|deref|deref_mut|new|as_ref|as_mut|borrow|borrow_mut|from|into|unwrap|expect|lock|read|write|upgrade|downgrade)(?:::<.*>)?$"
_CLOSURE = r"(\{closure@[^{}]+\})"
#: What a type parameter list is, three deep, and the arguments at the end of a call, with brackets inside, three deep.
_GENERIC = r"::<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
_ARGUMENTS = r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)$"


def _full(name: Column) -> Column:
    """A path or type with the heads of ``FULL`` written out."""
    for short, full in FULL.items():
        name = F.regexp_replace(name, rf"(?<![A-Za-z0-9_:]){short}(?=::<|<|::)", full)
    return F.regexp_replace(name, r"(?<![A-Za-z0-9_:])(Atomic[A-Z][A-Za-z0-9]*)(?=::)", "std::sync::atomic::$1")


def _func(name: Column) -> Column:
    """A function's name without braces, as in ``main::closure#0``."""
    return F.translate(name, "{}", "")


def _place(s: Column) -> Column:
    """The local that a place or operand is about, with its first field: ``_1`` or ``_1.0``; null for a constant."""
    local, field = F.regexp_extract(s, r"_(\d+)", 1), F.regexp_extract(s, r"_\d+\)*\.(\d+)", 1)
    return F.when(s.rlike(r"_\d+") & ~F.ltrim(s).startswith("const "), F.concat(F.lit("_"), local, F.when(field != "", F.concat(F.lit("."), field)).otherwise("")))


def parsed(texts: DataFrame, semantics: str = "strict") -> DataFrame:
    return counted(mir.lines(texts, semantics).withColumnRenamed("path", "net_id").withColumn("func", _func(F.col("fn"))), "parsed")


def typed_locals(lines: DataFrame) -> DataFrame:
    """(net_id, func, local, ty): declarations and parameters; a closure's type names the function that it runs."""
    s = lines.withColumnRenamed("net_id", "path")
    own = mir.local_decls(s).select(F.col("path").alias("net_id"), _func(F.col("fn")).alias("func"), "local", "ty")
    heads = lines.where("fn_here is not null").withColumn("p", F.regexp_extract("s", r"^fn [^(]*\((.*)\) -> ", 1))
    each = F.arrays_zip(F.regexp_extract_all("p", F.lit(r"(_\d+): "), F.lit(1)).alias("local"), F.slice(F.split("p", r"(?:^|, )_\d+: "), 2, 10_000).alias("ty"))
    params = heads.select("net_id", "func", F.explode(each).alias("x")).select("net_id", "func", "x.local", "x.ty")
    every = own.union(params).withColumn("ty", _full(F.col("ty"))).withColumn("closure", F.nullif(F.regexp_extract("ty", _CLOSURE, 1), F.lit("")))
    runs = params.where("local = '_1'").select("net_id", F.regexp_extract("ty", _CLOSURE, 1).alias("closure"), F.col("func").alias("runs")).where("closure != ''").groupBy("net_id", "closure").agg(F.min("runs").alias("runs"))
    whole = every.join(runs, ["net_id", "closure"], "left")
    return counted(whole.select("net_id", "func", "local", F.when(F.col("runs").isNotNull() & (F.trim("ty") == F.col("closure")), F.concat(F.lit("{closure@"), "runs", F.lit("}"))).otherwise(F.col("ty")).alias("ty"), F.when(F.trim("ty") == F.col("closure"), F.col("closure")).alias("closure"), "runs").distinct(), "locals")


def program_blocks(lines: DataFrame, semantics: str = "strict") -> DataFrame:
    """(net_id, func, bb, is_cleanup, is_empty_unreachable, term_kind, span, targets, callee, args, dest, dropped): blocks with any terminator; what ``mir`` does not
    know is told by the last line: unreachable, resume, an assertion, or a step to every block that it names."""
    table = mir.blocks(lines.withColumnRenamed("net_id", "path"), semantics).withColumnRenamed("path", "net_id")
    ends = lines.where("bb is not null and not shut and bb_here is null and trim(raw) != ''").groupBy("net_id", "fn_line", "bb").agg(F.max_by("s", "line").alias("end"))
    heads = lines.where("bb_here is not null").select("net_id", "fn", "fn_line", "bb", "bb_line").distinct()
    t = table.join(heads, ["net_id", "fn", "fn_line", "bb", "bb_line"], "left_semi").join(ends, ["net_id", "fn_line", "bb"], "left")
    to = F.transform(F.regexp_extract_all(F.substring_index("end", "->", -1), F.lit(r"bb(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    success = F.transform(F.regexp_extract_all("end", F.lit(r"success: bb(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    kind = F.coalesce("kind", F.when(F.col("end").startswith("unreachable"), "unreachable").when(F.col("end").startswith("resume") | F.col("end").startswith("unwind_resume"), "resume").when(F.col("end").startswith("assert("), "assert").when(F.col("end").contains("->"), "goto").otherwise("unreachable"))
    targets = F.when(F.col("kind").isNotNull(), F.col("targets")).when(F.col("end").startswith("assert("), success).when(F.col("end").contains("->"), to).otherwise(F.array().cast("array<int>"))
    # a call that never returns has only a way to unwind
    lost = F.col("kind").isNull() & ~F.col("end").startswith("assert(") & F.col("end").rlike(r"^(_\d+ = )?[A-Za-z<].*\) -> (unwind |bb\d+;|\[unwind)")
    # a call's name may have brackets in its type parameters, so its arguments are told from their end
    call = F.when(F.col("term_kind") == "call", F.trim(F.regexp_replace(F.expr("substring(end, 1, length(end) - length(substring_index(end, '->', -1)) - 2)"), r"^[^=<({]* = ", "")))
    args = F.regexp_extract(call, _ARGUMENTS, 1)
    name = F.trim(F.expr("substring(call, 1, length(call) - length(args) - 2)"))
    dest = F.nullif(F.regexp_extract("end", r"^(_\d+) = ", 1), F.lit(""))
    t = t.withColumn("term_kind", F.when(lost, "call").otherwise(kind)).withColumn("targets", F.when(lost, F.array().cast("array<int>")).otherwise(targets)).withColumn("dest", F.when(lost, dest).otherwise(F.col("dest")))
    t = t.withColumn("call", call).withColumn("args", args).withColumn("callee", name)
    return counted(t.select("net_id", _func(F.col("fn")).alias("func"), "bb", F.coalesce("cleanup", F.lit(False)).alias("is_cleanup"), F.lit(False).alias("is_empty_unreachable"), "term_kind", F.col("bb_line").cast("string").alias("span"), "targets", "callee", "args", "dest", "dropped"), "blocks")


def call_sites(blocks: DataFrame) -> DataFrame:
    """(net_id, func, bb, target, name, args, dest, span): calls, and drops as calls of drop."""
    target = F.try_element_at("targets", F.lit(1))
    calls = blocks.where("term_kind = 'call'").select("net_id", "func", "bb", target.alias("target"), _func(F.regexp_replace(_full(F.col("callee")), _GENERIC, "")).alias("name"), F.filter(F.split("args", r", (?![^<(\[]*[>)\]])"), lambda a: a != "").alias("args"), "dest", "span")
    drops = blocks.where("term_kind = 'drop'").select("net_id", "func", "bb", target.alias("target"), F.lit("std::mem::drop").alias("name"), F.array(F.concat(F.lit("move "), "dropped")).alias("args"), F.lit(None).cast("string").alias("dest"), "span")
    return counted(calls.union(drops), "sites")


def links(lines: DataFrame, sites: DataFrame, local_types: DataFrame, functions: DataFrame) -> DataFrame:
    """(net_id, f, a, g, b): places a of function f and b of g that lead to the same."""
    here = lambda d, a, b: d.select("net_id", F.col("func").alias("f"), a.alias("a"), F.col("func").alias("g"), b.alias("b"))
    s = lines.where("bb is not null and bb_here is null and not shut").where(F.col("s").rlike(r"^[^=]*_\d+[^=]* = ") & F.col("s").endswith(";") & ~F.col("s").contains(" -> "))
    parts = s.select("net_id", "func", _place(F.substring_index("s", " = ", 1)).alias("lhs"), F.expr("substring(s, instr(s, ' = ') + 3)").alias("rhs"))
    moved = here(parts.where(F.col("rhs").rlike(r"^(?:&|copy |move |\(*\**_)")), F.col("lhs"), _place(F.col("rhs")))
    made = parts.where(F.col("rhs").startswith("{closure@")).select("net_id", "func", "lhs", F.regexp_extract("rhs", _CLOSURE, 1).alias("closure"), F.posexplode(F.regexp_extract_all("rhs", F.lit(r"(?:move|copy) (_\d+)"), F.lit(1))).alias("i", "taken"))
    held = F.concat_ws(".", "lhs", F.col("i").cast("string"))
    runs = local_types.where("runs is not null and local = '_1'").select("net_id", "closure", "runs").where("closure is not null").distinct()
    captured = here(made, held, F.col("taken")).union(made.join(runs, ["net_id", "closure"]).select("net_id", F.col("func").alias("f"), held.alias("a"), F.col("runs").alias("g"), F.concat(F.lit("_1."), F.col("i").cast("string")).alias("b")))
    first = _place(F.try_element_at("args", F.lit(1)))
    handed = here(sites.where(F.col("name").rlike(HANDS_ON) & F.col("dest").isNotNull()), F.col("dest"), first)
    ends = sites.where(F.col("name").rlike(r"mpsc::(?:sync_)?channel(?:::<.*>)?$") & F.col("dest").isNotNull())
    pair = here(ends, F.concat("dest", F.lit(".0")), F.concat("dest", F.lit(".1")))
    known = sites.join(functions.select("net_id", F.col("func").alias("name")), ["net_id", "name"], "left_semi")
    into = known.select("net_id", F.col("func").alias("f"), "name", F.posexplode("args").alias("i", "arg")).select("net_id", "f", _place(F.col("arg")).alias("a"), F.col("name").alias("g"), F.concat(F.lit("_"), (F.col("i") + 1).cast("string")).alias("b"))
    back = known.where("dest is not null").select("net_id", F.col("func").alias("f"), F.col("dest").alias("a"), F.col("name").alias("g"), F.lit("_0").alias("b"))
    out = moved.union(captured).union(handed).union(pair).union(into).union(back)
    return counted(out.where("a is not null and b is not null"), "links")


def owners(of: DataFrame) -> DataFrame:
    """(net_id, func, local, res): the group of places that each place belongs to, by the name of its least one; places that are joined have joined fields."""
    node = lambda f, p: F.concat_ws("|", "net_id", f, p)
    edges = of.select(node("f", "a").alias("a"), node("g", "b").alias("b"))
    groups = counted(connected_components(edges), "groups")
    # a field of a place is one with the same field of the places that are joined to it
    base, field = F.regexp_replace("node", r"\.\d+$", ""), F.regexp_extract("node", r"\.(\d+)$", 1)
    fields = groups.where(field != "").select("node", base.alias("base"), field.alias("field"))
    same = fields.join(groups.select(F.col("node").alias("base"), F.col("component").alias("of")), "base").select(F.col("node").alias("a"), F.concat_ws(".", "of", "field").alias("b"))
    final = connected_components(edges.union(same))
    parts = F.split("node", r"\|")
    n = F.size(parts)
    named = final.select(F.array_join(F.slice(parts, F.lit(1), n - 2), "|").alias("net_id"), F.element_at(parts, n - 1).alias("func"), F.element_at(parts, n).alias("local"), F.col("component"))
    return counted(named.select("net_id", "func", "local", F.expr("substring(component, length(net_id) + 2)").alias("res")).select("net_id", "func", "local", F.concat(F.lit("r:"), F.translate("res", "|", ":")).alias("res")), "owners")


def resources(sites: DataFrame, local_types: DataFrame, own: DataFrame) -> DataFrame:
    """(net_id, res, kind) of all locks, condition variables, channels and atomic variables that a local leads to."""
    at = ["net_id", "func", "local"]
    guards = collect.lock_guards(local_types).join(own, at).select("net_id", "res", F.when(F.col("kind") == "mutex", "mutex").otherwise("rwlock").alias("kind"))
    ends = collect.channel_ends(local_types).join(own, at).select("net_id", "res", F.lit("channel").alias("kind"))
    waits = sites.where(F.lower("name").contains("condvar")).select("net_id", "func", _place(F.try_element_at("args", F.lit(1))).alias("local")).join(own, at).select("net_id", "res", F.lit("condvar").alias("kind"))
    atomics = collect.atomic_operations(sites).join(own, at).select("net_id", "res", F.lit("atomic").alias("kind"))
    return guards.union(ends).union(waits).union(atomics).groupBy("net_id", "res").agg(F.min("kind").alias("kind"))


def program_net(texts: DataFrame, entry: str = "main", semantics: str = "strict") -> Net:
    """The net of each text (path, text), by its path."""
    lines = parsed(texts, semantics)
    functions = counted(lines.where("fn_here is not null").select("net_id", "func", (F.col("func") == entry).alias("is_entry")).distinct(), "functions")
    local_types, blocks = typed_locals(lines), program_blocks(lines, semantics)
    sites = call_sites(blocks)
    own = owners(links(lines, sites, local_types, functions))
    calls = collect.dispatched(sites, local_types.select("net_id", "func", "local", "ty"), own, functions, blocks=blocks, semantics=semantics)
    # drops are calls here, and what a call needs but no local leads to is left out of it
    needs = calls.where("res is not null or not action rlike '_lock$|^unlock|^notify$|^wait$|^send$|^recv$|^atomic'")
    plain = calls.join(needs.select("net_id", "func", "bb"), ["net_id", "func", "bb"], "left_anti").withColumn("action", F.lit("plain"))
    blocks = blocks.withColumn("term_kind", F.when(F.col("term_kind") == "drop", "call").otherwise(F.col("term_kind"))).drop("callee", "args", "dest", "dropped")
    return translate.translate(functions, blocks, needs.unionByName(plain), resources(sites, local_types.select("net_id", "func", "local", "ty"), own), semantics=semantics, entry=entry)
