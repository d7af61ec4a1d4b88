"""Compiler IR text to tables of functions, locals, blocks and terminators, and from those to a net.

A line is the unit: text is cut into numbered lines, the function and the block of a line are the last heads before it (a window
over one file), and the terminator of a block is its last line of a terminator's form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrelspark.functions.classify import first_local

_WORD = "^[A-Za-z0-9_]+$"
_LOCAL = "^_[0-9]+$"


def _before(s, mark: str) -> Column:
    return F.trim(F.substring_index(s, mark, 1))


def _after(s, mark: str) -> Column:
    """What follows the first ``mark``; empty without one."""
    return F.trim(F.when(F.instr(s, mark) > 0, F.substring(s, F.instr(s, mark) + len(mark), F.length(s))).otherwise(""))


def function_name(s: Column, semantics: str = "strict") -> Column:
    """The name in ``fn name(arguments) -> type {``, also of methods and closures; null in any other line.  ``compat`` knows plain words alone."""
    name = _before(F.substring(s, F.lit(4), F.length(s)), "(")
    return F.when(s.startswith("fn ") & s.endswith("{") & s.contains("->") & (name.rlike(_WORD) if semantics == "compat" else name != ""), name)


def unknown_heads(texts: DataFrame, semantics: str = "strict") -> DataFrame:
    """(path, line, s): lines that begin a function and are not understood, such as heads over several lines."""
    at = texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("path", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("s"))
    return at.where(F.col("s").startswith("fn ") & function_name(F.col("s"), semantics).isNull())


def block_number(s: Column) -> Column:
    """The number in ``bb4: {`` or ``bb4 (cleanup): {``; null in any other line."""
    head = _before(s, ":")
    name = F.replace(head, F.lit("(cleanup)"), F.lit(""))
    return F.when(s.startswith("bb") & s.endswith("{"), F.substring(F.trim(name), F.lit(3), F.length(s)).try_cast("int"))


def goal(s: Column) -> Column:
    """The number of ``bb4``; null for anything else."""
    return F.when(F.trim(s).startswith("bb"), F.substring(F.trim(s), F.lit(3), F.length(s)).try_cast("int"))


def with_terminators(rows: DataFrame, semantics: str) -> DataFrame:
    """``rows`` with ``t``, (kind, targets, callee, args, dest, dropped) of a line ``s`` in a terminator's form, ``what -> target;`` or
    ``what -> [name: target, ...];``; null for any other line.

    ``compat`` does not know an unwind action without a colon, nor the action ``unreachable``.  What is read more than once is a column of its own, as Spark
    would work it out again for each place that it stands in."""
    c = F.col
    unwinds = ["continue"] + (["unreachable"] if semantics == "strict" else [])
    plain = ["unwind continue", "unwind unreachable"] if semantics == "strict" else []
    fine = lambda i: (i["name"] == "return") | ((i["name"] == "unwind") & (goal(i["to"]).isNotNull() | i["to"].isin(unwinds) | i["to"].startswith("terminate"))) | i["name"].isin(plain) | i["name"].startswith("unwind terminate")
    inner = lambda c: F.trim(F.substring(c, F.instr(c, "(") + 1, F.length(c) - F.instr(c, "(") - 1))
    d = rows.withColumn("t_bare", _before(c("s"), " //"))
    d = d.withColumn("t_line", F.substring(c("t_bare"), F.lit(1), F.length("t_bare") - 1))
    d = d.withColumn("t_last", F.substring_index("t_line", "->", -1))
    d = d.withColumns({"t_way": F.trim("t_last"), "t_what": F.trim(F.substring(c("t_line"), F.lit(1), F.length("t_line") - F.length("t_last") - 2))})
    items = F.transform(F.split(F.translate("t_way", "[]", ""), ","), lambda x: F.struct(_before(x, ":").alias("name"), F.when(x.contains(":"), F.trim(F.substring_index(x, ":", -1))).alias("to")))
    d = d.withColumns({"t_listed": c("t_way").startswith("[") & c("t_way").endswith("]"), "t_items": items, "t_goal": goal(c("t_way")), "t_gives": F.instr("t_what", " = ") > 0})
    d = d.withColumns({"t_back": F.filter("t_items", lambda i: i["name"] == "return"), "t_call": F.when(c("t_gives"), _after(c("t_what"), " = ")).otherwise(c("t_what"))})
    d = d.withColumn("t_to", goal(F.try_element_at("t_back", F.lit(1))["to"]))
    d = d.withColumn("t_returns", c("t_listed") & (F.size("t_back") == 1) & F.forall("t_items", fine) & c("t_to").isNotNull())
    d = d.withColumn("t_kind", (
        F.when(~c("t_bare").endswith(";"), None).when(F.trim("t_line") == "return", "return").when((c("t_what") == "goto") & c("t_goal").isNotNull(), "goto").when(c("t_what").startswith("switchInt(") & c("t_listed"), "switch")
        .when(c("t_what").startswith("drop(") & c("t_returns"), "drop").when(c("t_returns") & c("t_call").contains("(") & c("t_call").endswith(")"), "call")
    ))
    kind, is_call, left = c("t_kind"), c("t_kind") == "call", _before(c("t_what"), " = ")
    targets = F.when(kind == "goto", F.array("t_goal")).when(kind.isin("drop", "call"), F.array("t_to")).when(kind == "switch", F.filter(F.transform("t_items", lambda i: goal(i["to"])), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))
    dest = F.when(is_call & c("t_gives") & left.rlike(_WORD), left)
    t = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), targets.alias("targets"), F.when(is_call, _before(c("t_call"), "(")).alias("callee"), F.when(is_call, inner(c("t_call"))).alias("args"), dest.alias("dest"), F.when(kind == "drop", inner(c("t_what"))).alias("dropped")))
    return d.select(*rows.columns, t.alias("t"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files under ``path``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(texts: DataFrame, semantics: str = "strict") -> DataFrame:
    """(path, line, raw, fn, fn_line, bb, cleanup, bb_line): every line with the function and block that it stands in."""
    # texts are dealt by path before they are cut, into a fixed number of parts as texts that are alike shrink so much in a shuffle that few would be
    # left; one window in the order of the lines tells all heads before a line
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = texts.repartition(parts, "path").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("path", (F.col("pos") + 1).alias("line"), "raw", F.trim("raw").alias("s"))
    at = at.withColumns({"fn_here": function_name(F.col("s"), semantics), "bb_here": block_number(F.col("s")), "closes": F.col("s") == "}"})
    w = Window.partitionBy("path").orderBy("line")
    head = lambda when, *more: F.last(F.when(when, F.struct("line", *more)), True).over(w)
    at = at.withColumns({
        "of_fn": head(F.col("fn_here").isNotNull(), F.col("fn_here").alias("fn")), "of_bb": head(F.col("bb_here").isNotNull(), F.col("bb_here").alias("bb"), F.col("raw").contains("(cleanup)").alias("cleanup")), "closed": head(F.col("closes"))["line"],
    }).where("of_fn is not null")
    own = lambda c: F.when(F.col("of_bb.line") >= F.col("of_fn.line"), F.col(f"of_bb.{c}"))  # noqa: E731  # a block of an earlier function is none of this one
    at = at.select("path", "line", "raw", "s", "fn_here", F.col("of_fn.fn").alias("fn"), F.col("of_fn.line").alias("fn_line"), "bb_here", "closes", own("bb").alias("bb"), own("line").alias("bb_line"), own("cleanup").alias("cleanup"), "closed")
    return at.withColumn("shut", F.coalesce(F.col("closed") >= F.col("bb_line"), F.lit(False))).drop("closed")


def functions(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "fn", "fn_line").distinct()


def local_decls(parsed: DataFrame) -> DataFrame:
    """(path, fn, local, ty, is_mut) of the declarations before the first block."""
    s = F.col("s")
    what = F.trim(F.when(s.startswith("let mut "), _after(s, "let mut ")).otherwise(_after(s, "let ")))
    local = _before(what, ":")
    d = parsed.where("bb is null").where(s.startswith("let ") & s.endswith(";") & s.contains(":") & local.rlike(_LOCAL))
    return d.select("path", "fn", local.alias("local"), _before(_after(what, ":"), ";").alias("ty"), s.startswith("let mut ").alias("is_mut"))


def refs(parsed: DataFrame) -> DataFrame:
    """(path, fn, ref, base): the last ``ref = &base;`` of each local, in blocks."""
    s = F.col("s")
    ref, base = _before(s, "="), _before(_after(s, "&"), ";")
    form = s.endswith(";") & F.replace(s, F.lit(" "), F.lit("")).contains("=&") & ref.rlike(_LOCAL) & base.rlike(_LOCAL)
    r = parsed.where("bb is not null and not shut").where(form).select("path", "fn", ref.alias("ref"), base.alias("base"), "line")
    return r.groupBy("path", "fn", "ref").agg(F.max_by("base", "line").alias("base"))


def blocks(parsed: DataFrame, semantics: str = "strict") -> DataFrame:
    """(path, fn, bb, cleanup, bb_line, kind, targets, callee, args, dest, dropped): blocks with their terminators; kind is null without one."""
    # a line without an arrow can only be a return
    some = parsed.where("bb is not null and not shut and bb_here is null").where(F.col("s").contains("->") | F.col("s").contains("return"))
    keys = ["path", "fn", "fn_line", "bb", "bb_line"]
    found = with_terminators(some.select(*keys, "line", "s"), semantics).withColumn("of_line", F.when(F.col("t").isNotNull(), F.col("line")))
    last = found.groupBy(*keys).agg(F.max_by("t", "of_line").alias("t")).select("path", "fn_line", "bb_line", "t.*")
    heads = parsed.where("bb_here is not null").select("path", "fn", "fn_line", "bb", "cleanup", "bb_line")
    return heads.join(last, ["path", "fn_line", "bb_line"], "left")


def is_lock(callee) -> F.Column:
    return (callee.contains("Mutex") & callee.contains("lock")) | F.lower(callee).contains("mutex::lock")


def guards(parsed: DataFrame, table: DataFrame, max_chain: int = 32) -> DataFrame:
    """(path, fn, guard, mutex): locals that hold a lock's guard; unwrap and expect hand it on."""
    from petrelspark.staging import settle

    r = refs(parsed)
    calls = table.where("kind = 'call' and dest is not null").withColumn("arg", first_local(F.col("args"))).where("arg is not null")
    lock = is_lock(F.col("callee"))
    found = calls.where(lock).join(r.withColumnRenamed("ref", "arg"), ["path", "fn", "arg"], "left").select("path", "fn", F.col("dest").alias("guard"), F.coalesce("base", "arg").alias("mutex"), "bb_line")
    found = settle(found.groupBy("path", "fn", "guard").agg(F.max_by("mutex", "bb_line").alias("mutex")))
    hand = settle(calls.where(~lock & (F.col("callee").contains("::unwrap") | F.col("callee").contains("::expect"))).select("path", "fn", F.col("arg").alias("guard"), "dest"))
    front = found
    for _ in range(max_chain):
        front = settle(front.join(hand, ["path", "fn", "guard"]).select("path", "fn", F.col("dest").alias("guard"), "mutex").join(found, ["path", "fn", "guard"], "left_anti").distinct())
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def net_rows(texts: DataFrame, entry: str = "main", semantics: str = "strict", max_fns: int | None = None) -> dict[str, DataFrame]:
    """places(path, id, name, kind, init_tokens), transitions(path, id, name, kind, op), arcs(path, source, target, weight), warnings(path, function, basic_block, line, reason, callee).

    Each block that is no cleanup is a place; each target of its terminator is a transition.  A lock takes its mutex from free to held, the
    drop of its guard gives it back.  ``max_fns``: the first so many functions of each file."""
    from petrelspark.staging import settle

    parsed = settle(lines(texts, semantics))
    if max_fns is not None:
        order = functions(parsed).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("fn_line"))).where(F.col("k") <= max_fns)
        parsed = parsed.join(order.select("path", "fn_line"), ["path", "fn_line"], "left_semi")
    every = settle(blocks(parsed, semantics))
    bound = guards(parsed, every)
    table = every.where("not cleanup")
    fns = functions(parsed)
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts])
    place = lambda d, i, n, kind, tokens: d.select("path", i.alias("id"), n.alias("name"), F.lit(kind).alias("kind"), tokens.cast("int").alias("init_tokens"))
    none = F.lit(0)
    places = place(fns, name("p_", "$fn", "_entry"), name("$fn", "_entry"), "cfg", F.when(F.col("fn") == entry, 1).otherwise(0)).union(place(fns, name("p_", "$fn", "_exit"), name("$fn", "_exit"), "cfg", none)).union(place(table, name("p_", "$fn", "_bb", "$bb"), name("$fn", "_bb", "$bb"), "cfg", none))
    first = table.groupBy("path", "fn").agg(F.min_by("bb", "bb_line").alias("bb"))
    r = refs(parsed).withColumnRenamed("ref", "arg")
    t = table.withColumn("arg", first_local(F.col("args"))).withColumn("locks", F.coalesce(is_lock(F.col("callee")), F.lit(False))).join(r, ["path", "fn", "arg"], "left").join(bound.select("path", "fn", F.col("guard").alias("dropped"), F.col("mutex").alias("held")), ["path", "fn", "dropped"], "left")
    t = settle(t.withColumn("lock", F.when(F.col("locks"), F.coalesce("base", "arg"))).withColumn("unlock", F.when(F.col("kind") == "drop", F.col("held"))))
    moves = t.select("*", F.explode("targets").alias("to")).withColumn("id", name("t_", "$fn", "_bb", "$bb", "_to_bb", "$to"))
    kind = F.when(F.col("lock").isNotNull(), "lock").when(F.col("unlock").isNotNull(), "unlock").otherwise("cfg")
    cfg = F.lit(None).cast("string")
    ret = t.where("kind = 'return'").withColumn("id", name("t_", "$fn", "_bb", "$bb", "_return"))
    starts = first.withColumn("id", name("t_", "$fn", "_start"))
    trans = moves.select("path", "id", name("$fn", "_bb", "$bb", "_to_bb", "$to").alias("name"), kind.alias("kind"), F.coalesce("lock", "unlock").alias("op")).union(ret.select("path", "id", name("$fn", "_bb", "$bb", "_return"), F.lit("cfg"), cfg)).union(starts.select("path", "id", name("$fn", "_start"), F.lit("cfg"), cfg)).distinct()
    arc = lambda d, a, b: d.select("path", a.alias("source"), b.alias("target"), F.lit(1).alias("weight"))
    i = F.col("id")
    there = table.select("path", "fn", F.col("bb").alias("to")).distinct()
    key = lambda c, end: F.concat(F.lit("p_mutex_"), F.col(c), F.lit(end))
    lk, un = moves.where("lock is not null"), moves.where("lock is null and unlock is not null")
    arcs = arc(starts, name("p_", "$fn", "_entry"), i).union(arc(starts, i, name("p_", "$fn", "_bb", "$bb"))).union(arc(moves, name("p_", "$fn", "_bb", "$bb"), i)).union(arc(moves.join(there, ["path", "fn", "to"], "left_semi"), i, name("p_", "$fn", "_bb", "$to"))).union(arc(ret, name("p_", "$fn", "_bb", "$bb"), i)).union(arc(ret, i, name("p_", "$fn", "_exit")))
    arcs = arcs.union(arc(lk, key("lock", "_free"), i)).union(arc(lk, i, key("lock", "_held"))).union(arc(un, key("unlock", "_held"), i)).union(arc(un, i, key("unlock", "_free")))
    used = lk.select("path", F.col("lock").alias("m")).union(un.select("path", "unlock")).distinct()
    places = places.union(place(used, name("p_mutex_", "$m", "_free"), name("mutex_", "$m", "_free"), "mutex_free", F.lit(1))).union(place(used, name("p_mutex_", "$m", "_held"), name("mutex_", "$m", "_held"), "mutex_held", none)).distinct()
    reason = F.when(F.col("kind").isNull(), "no terminator found").when((F.col("kind") == "drop") & F.col("held").isNull(), F.concat(F.lit("drop("), "dropped", F.lit(") not in guard binding table"))).when((F.col("kind") == "call") & F.col("locks") & F.col("arg").isNull(), "Mutex::lock call but no local in args").when((F.col("kind") == "call") & ~F.col("locks"), "unrecognized call, treated as CFG edge")
    warnings = t.select("path", F.col("fn").alias("function"), name("bb", "$bb").alias("basic_block"), F.col("bb_line").alias("line"), reason.alias("reason"), F.when(F.col("kind") == "drop", "drop").otherwise(F.col("callee")).alias("callee")).where("reason is not null")
    none_ = F.lit(None).cast("string")
    heads = unknown_heads(texts, semantics).select("path", none_.alias("function"), none_.alias("basic_block"), "line", F.lit("function head not understood").alias("reason"), F.substring("s", 1, 200).alias("callee"))
    warnings = warnings.unionByName(heads)
    return {"places": places, "transitions": trans, "arcs": arcs, "warnings": warnings}
