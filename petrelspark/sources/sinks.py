"""Nets and graphs as PNML, DOT and JSON text, one row for each net.

A document is put together from sorted rows of one net, so its size is that of the net."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.functions.markings import dot_escape, xml_escape
from petrelspark.operators.explore import StateGraph
from petrelspark.plans.net import ARCS, PLACES, TRANSITIONS, Net


def _text(df: DataFrame, by: str, order: list[str], line: Column, name: str) -> DataFrame:
    rows = df.select(by, F.struct(*order, line.alias("_line")).alias("r")).groupBy(by).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(by, F.array_join(F.transform("rs", lambda r: r["_line"]), "\n").alias(name))


def pnml(rows: dict[str, DataFrame], by: str = "path") -> DataFrame:
    """(path, xml): PNML of net rows with text ids; a marking only where there are tokens, an inscription only for other weights than 1.

    ``annotations``, if the places have such a column (map), goes to a tool-specific element."""
    q = lambda c: xml_escape(F.col(c))
    p = rows["places"]
    label = lambda tag, c: F.concat(F.lit(f"<{tag}><text>"), c, F.lit(f"</text></{tag}>"))
    marks = F.when(F.col("init_tokens") > 0, label("initialMarking", F.col("init_tokens").cast("string"))).otherwise("")
    extra = F.lit("")
    if "annotations" in p.columns:
        notes = F.array_join(F.transform(F.map_entries("annotations"), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), xml_escape(e["value"]), F.lit("</"), e["key"], F.lit(">"))), "")
        extra = F.when(F.size(F.col("annotations")) > 0, F.concat(F.lit('<toolspecific tool="petrelspark" version="1">'), notes, F.lit("</toolspecific>"))).otherwise("")
    ps = _text(p, by, ["id"], F.concat(F.lit('    <place id="'), q("id"), F.lit('">'), label("name", q("name")), marks, extra, F.lit("</place>")), "ps")
    ts = _text(rows["transitions"], by, ["id"], F.concat(F.lit('    <transition id="'), q("id"), F.lit('">'), label("name", q("name")), F.lit("</transition>")), "ts")
    weight = F.when(F.col("weight") != 1, label("inscription", F.col("weight").cast("string"))).otherwise("")
    arcs = _text(rows["arcs"], by, ["source", "target"], F.concat(F.lit('    <arc id="arc_'), q("source"), F.lit("_"), q("target"), F.lit('" source="'), q("source"), F.lit('" target="'), q("target"), F.lit('">'), weight, F.lit("</arc>")), "arcs")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<pnml xmlns="http://www.pnml.org/version-2009/grammar/pnml">\n  <net id="net" type="http://www.pnml.org/version-2009/grammar/ptnet">\n   <page id="page">\n'
    joined = ps.join(ts, by, "left").join(arcs, by, "left")
    return joined.select(by, F.concat(F.lit(head), F.concat_ws("\n", "ps", "ts", "arcs"), F.lit("\n   </page>\n  </net>\n</pnml>\n")).alias("xml"))


def net_json(rows: dict[str, DataFrame], by: str = "path") -> DataFrame:
    """(path, json): places, transitions, arcs, initial_marking and warnings of net rows."""
    pack = lambda d, name: d.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in d.columns if c != by]))).alias(name))
    out = pack(rows["places"], "places")
    for k in ("transitions", "arcs", "warnings"):
        out = out.join(pack(rows[k], k), by, "left")
    marks = F.map_from_entries(F.transform(F.filter("places", lambda p: p["init_tokens"] > 0), lambda p: F.struct(p["id"], p["init_tokens"])))
    return out.select(by, F.to_json(F.struct("places", "transitions", "arcs", marks.alias("initial_marking"), "warnings")).alias("json"))


def net_dot(net: Net) -> DataFrame:
    """(net_id, dot) of nets."""
    p = net.places.select("net_id", F.lit(0).alias("g"), F.col("place_id").alias("k"), F.lit(0).alias("k2"), F.format_string('  p%d [shape=circle, label="%s\\n(%d)"];', "place_id", dot_escape(F.col("name")), "tokens").alias("l"))
    t = net.transitions.select("net_id", F.lit(1), "trans_id", F.lit(0), F.format_string('  t%d [shape=box, label="%s"];', "trans_id", dot_escape(F.col("name"))))
    w = F.when(F.col("weight") > 1, F.format_string(' [label="%d"]', "weight")).otherwise("")
    line = F.when(F.col("direction") == "in", F.format_string("  p%d -> t%d%s;", "place_id", "trans_id", w)).when(F.col("direction") == "out", F.format_string("  t%d -> p%d%s;", "trans_id", "place_id", w)).otherwise(F.format_string("  p%d -> t%d [style=dashed, label=%s];", "place_id", "trans_id", "direction"))
    a = net.weights().select("net_id", F.lit(2), "trans_id", "place_id", line)
    body = _text(p.union(t).union(a), "net_id", ["g", "k", "k2"], F.col("l"), "body")
    return body.select("net_id", F.concat(F.lit("digraph net {\n"), "body", F.lit("\n}\n")).alias("dot"))


def graph_dot(graph: StateGraph) -> DataFrame:
    """(net_id, dot) of state graphs; states without an enabled transition are drawn double."""
    marks = graph.snapshots().groupBy("net_id", "state_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("tokens").cast("string")))), " ").alias("m"))
    s = graph.states.join(marks, ["net_id", "state_id"], "left").select("net_id", F.lit(0).alias("g"), F.col("state_id").alias("k"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("k3"), F.format_string('  s%d [label="%s"%s];', "state_id", dot_escape(F.coalesce("m", F.lit(""))), F.when(F.size("enabled") == 0, F.lit(", peripheries=2")).otherwise("")).alias("l"))
    e = graph.edges.join(graph.net.transitions.select("net_id", "trans_id", "name"), ["net_id", "trans_id"]).select("net_id", F.lit(1), "src", "dst", "trans_id", F.format_string('  s%d -> s%d [label="%s"];', "src", "dst", dot_escape(F.col("name"))))
    body = _text(s.union(e), "net_id", ["g", "k", "k2", "k3"], F.col("l"), "body")
    return body.select("net_id", F.concat(F.lit("digraph states {\n"), "body", F.lit("\n}\n")).alias("dot"))


def call_dot(calls: DataFrame) -> DataFrame:
    """(graph, dot) of call edges (caller, callee)."""
    e = calls.select("caller", "callee").distinct().select(F.lit("calls").alias("graph"), "caller", "callee", F.format_string("  f%d -> f%d;", "caller", "callee").alias("l"))
    body = _text(e, "graph", ["caller", "callee"], F.col("l"), "body")
    return body.select("graph", F.concat(F.lit("digraph calls {\n"), "body", F.lit("\n}\n")).alias("dot"))


def cfg_dot(statements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func, dot) of control flow: blocks (func, bb, targets) with the first three of their statements (func, bb, seq, text)."""
    first = statements.groupBy("func", "bb").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s")).select("func", "bb", F.transform(F.slice("s", 1, 3), lambda x: x["text"]).alias("t"), (F.size("s") > 3).alias("more"))
    text = F.concat_ws("\n", F.col("t"), F.when(F.col("more"), "..."))
    b = blocks.join(first, ["func", "bb"], "left").select("func", F.lit(0).alias("g"), "bb", F.lit(0).alias("to"), F.format_string('  bb%d [shape=box, label="bb%d\\n%s"];', "bb", "bb", dot_escape(text)).alias("l"))
    e = blocks.select("func", "bb", F.explode("targets").alias("to")).select("func", F.lit(1), "bb", "to", F.format_string("  bb%d -> bb%d;", "bb", "to"))
    body = _text(b.union(e), "func", ["g", "bb", "to"], F.col("l"), "body")
    return body.select("func", F.concat(F.lit("digraph cfg {\n"), "body", F.lit("\n}\n")).alias("dot"))


def banner(title: str, *pairs: tuple[str, Column]) -> Column:
    """The text form of a report: a title, then a line for each pair."""
    return F.concat_ws("\n", F.lit(f"==== {title} ===="), *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("none"))) for k, v in pairs])


def summary(graph: StateGraph, problems: DataFrame) -> DataFrame:
    """(net_id, seven counts): places, transitions, arcs, states, edges, terminal states, reported problems."""
    n = lambda d, name: d.groupBy("net_id").agg(F.count("*").alias(name))
    out = graph.stats().select("net_id", "states", "edges", F.col("deadlocks").alias("terminal_states"))
    for d, name in ((graph.net.places, "places"), (graph.net.transitions, "transitions"), (graph.net.weights(), "arcs"), (problems, "problems")):
        out = out.join(n(d, name), "net_id", "left")
    return out.na.fill(0)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("error").json(path)


def race_report(races: DataFrame, by: str = "net_id") -> DataFrame:
    """(net_id, text): the text form of ``merged_races``."""
    line = banner("Data race", ("location", F.col("location")), ("block", F.col("block")), ("span", F.col("span")), ("pairs", F.col("pairs")), ("operations", F.array_join("operations", ", ")))
    return _text(races, by, ["location", "block", "span"], line, "text")


def atomicity_report(found: DataFrame, by: str = "net_id") -> DataFrame:
    """(net_id, text): the text form of ``atomicity``."""
    line = banner("Atomicity violation", ("variable", F.col("var")), ("load", F.col("load")), ("stores", F.array_join("stores", ", ")))
    return _text(found, by, ["var", "load"], line, "text")


def write_net(net: Net, path: str) -> None:
    """A net as JSON lines: one folder for each of its tables."""
    for name in ("places", "transitions", "arcs"):
        getattr(net, name).write.mode("error").json(f"{path}/{name}")


def read_net(spark: SparkSession, path: str) -> Net:
    """The net that ``write_net`` wrote."""
    return Net(*(spark.read.schema(s).json(f"{path}/{name}") for name, s in (("places", PLACES), ("transitions", TRANSITIONS), ("arcs", ARCS))))


def collected_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, json): the rows of collectors, such as atomics or channels, as JSON."""
    parts = [d.select(F.lit(k).alias("kind"), F.to_json(F.struct("*")).alias("json")) for k, d in tables.items()]
    return reduce(DataFrame.union, parts)


def write_points_to(report: DataFrame, path: str) -> None:
    """The report of points-to sets as text, a line for each set."""
    report.select(F.concat_ws(" ", "func", "node", F.concat(F.lit("-> {"), F.array_join("targets", ", "), F.lit("}"))).alias("value")).write.mode("error").text(path)


def write_bench(table: DataFrame, path: str) -> None:
    """The benchmark table as CSV with a header."""
    table.write.mode("error").option("header", True).csv(path)


def bench_tex(table: DataFrame) -> DataFrame:
    """(detector, case, tex): rows of a TeX table."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns]
    return table.select("detector", "case", F.concat(F.concat_ws(" & ", *rest), F.lit(" \\\\")).alias("tex"))
