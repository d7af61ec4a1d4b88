"""Inclusion-based points-to sets by semi-naive rounds with collapsed cycles, and alias queries on them.

Constraints (func, src, dst, kind): Address ``dst = &src``, Copy and AliasCopy ``dst = src``, Load ``dst = *src``, Store ``*dst = src``.
Every place also points to its own allocation, written ``Alloc(place)``.  A place pointed to by name receives what is stored
through the pointer, and gives what is loaded.  Only the facts of the last round are joined again.

Facts never leave a function, so the constraints of one that has at most ``MOST`` meet in a row, are solved there, and are dealt once; only larger
functions take rounds over all executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.functions.classify import ALIAS_RANK
from petrelspark.operators.cycles import strong_components
from petrelspark.staging import settle


#: Constraints of a function that may meet in a row.
MOST = 256


def _least(constraints: list[dict], allocations: bool) -> dict[str, set[str]]:
    """The targets of each node of one function."""
    pts, copies, loads, stores, work = defaultdict(set), defaultdict(set), defaultdict(list), defaultdict(list), []

    def copy(src: str, dst: str) -> None:
        if src != dst and dst not in copies[src]:
            copies[src].add(dst)
            work.extend((dst, t) for t in pts[src])

    for c in constraints:
        src, dst, kind = c["src"], c["dst"], c["kind"]
        if kind == "Load":
            loads[src].append(dst)
        elif kind == "Store":
            stores[dst].append(src)
        elif kind in ("Copy", "AliasCopy"):
            copy(src, dst)
        elif kind == "Address":
            work.append((dst, src))
        if allocations:
            work.extend((n, f"Alloc({n})") for n in (src, dst))
    while work:
        node, target = work.pop()
        if target in pts[node]:
            continue
        pts[node].add(target)
        work.extend((d, target) for d in copies[node])
        if not target.startswith("Alloc("):
            for d in loads[node]:
                copy(target, d)
            for x in stores[node]:
                copy(x, target)
    return pts


def _solved(allocations: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = [(r["func"], n, t) for r in batch.slice(k, 64).to_pylist() for n, ts in _least(r["constraints"], allocations).items() for t in ts]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["func", "node", "target"])

    return run


def points_to(constraints: DataFrame, allocations: bool = True, max_rounds: int = 10_000, fields: bool = False, most: int = MOST) -> DataFrame:
    """(func, node, target): the least solution.  Rows with a null end are left out.

    ``fields``: a place such as ``_1.0.2`` also points where ``_1.0`` and ``_1`` do, while solving: what they get later reaches it, and is loaded and stored through it.

    ``most``: functions with more constraints are solved by rounds (``in_rounds``)."""
    c = settle(constraints.select("func", "src", "dst", "kind").where("func is not null and src is not null and dst is not null").distinct())
    if fields:
        ends = c.select("func", F.col("src").alias("node")).union(c.select("func", "dst")).distinct()
        c = settle(c.unionByName(field_copies(ends)).distinct())
    large = settle(c.groupBy("func").count().where(F.col("count") > most).select("func"))
    small = c.join(large, "func", "left_anti").groupBy("func").agg(F.collect_list(F.struct("src", "dst", "kind")).alias("constraints"))
    found = small.mapInArrow(_solved(allocations), "func string, node string, target string")
    if not large.isEmpty():
        found = found.unionByName(in_rounds(settle(c.join(large, "func", "left_semi")), allocations, max_rounds))
    return settle(found)


def in_rounds(c: DataFrame, allocations: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(func, node, target) of distinct constraints without nulls, by semi-naive rounds.

    Nodes that copy to each other have one set, so while solving they are one (``strong_components`` of the copies); facts move along the edges between
    them.  Loads and stores make new copies from the facts of the last round, and what those close to a cycle becomes one in turn."""
    ends = c.select("func", F.col("src").alias("node")).union(c.select("func", "dst")).distinct()
    of = lambda kind: c.where(F.col("kind") == kind).select("func", "src", "dst")
    loads, stores = of("Load"), of("Store")
    copies = settle(c.where("kind in ('Copy', 'AliasCopy')").select("func", "src", "dst").distinct())
    one = settle(strong_components(copies, ["func"], ends).toDF("func", "node", "rep"))

    def on(d: DataFrame, column: str) -> DataFrame:
        return d.join(one.withColumnsRenamed({"node": column, "rep": f"{column}_rep"}), ["func", column])

    def between(d: DataFrame) -> DataFrame:
        return on(on(d, "src"), "dst").where("src_rep != dst_rep").select("func", F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst")).distinct()

    def along(facts: DataFrame, edges: DataFrame) -> DataFrame:
        return facts.join(edges.withColumnRenamed("src", "rep"), ["func", "rep"]).select("func", F.col("dst").alias("rep"), "target")

    facts = on(of("Address").select("func", F.col("dst").alias("node"), F.col("src").alias("target")), "node").select("func", F.col("node_rep").alias("rep"), "target")
    if allocations:
        facts = facts.union(one.select("func", "rep", F.concat(F.lit("Alloc("), "node", F.lit(")"))))
    edges = settle(between(copies))
    known = fresh = settle(facts.distinct())
    since = fresh  # the facts that loads and stores haven't seen
    for _ in range(max_rounds):
        while not fresh.isEmpty():
            fresh = settle(along(fresh, edges).distinct().join(known, ["func", "rep", "target"], "left_anti"))
            known, since = known.union(fresh), since.union(fresh)
        places = since.where(~F.col("target").startswith("Alloc("))
        by_load = places.join(on(loads, "src").withColumnRenamed("src_rep", "rep"), ["func", "rep"]).select("func", F.col("target").alias("src"), "dst")
        by_store = places.join(on(stores, "dst").withColumnRenamed("dst_rep", "rep"), ["func", "rep"]).select("func", "src", F.col("target").alias("dst"))
        made = by_load.union(by_store).where("src != dst").distinct().join(copies, ["func", "src", "dst"], "left_anti")
        made = settle(made)
        if made.isEmpty():
            break
        copies = settle(copies.union(made))
        merged = strong_components(edges.union(between(made)), ["func"]).toDF("func", "rep", "now").where("rep != now")
        merged = settle(merged)
        one = settle(one.join(merged, ["func", "rep"], "left").select("func", "node", F.coalesce("now", "rep").alias("rep")))
        known = settle(known.join(merged, ["func", "rep"], "left").select("func", F.coalesce("now", "rep").alias("rep"), "target").distinct())
        edges = settle(between(copies))
        since = known.join(merged.select("func", F.col("now").alias("rep")).distinct(), ["func", "rep"], "left_semi")  # each part of a merged node has to see the others' facts
        fresh = settle(along(known, edges).distinct().join(known, ["func", "rep", "target"], "left_anti"))
        known, since = known.union(fresh), since.union(fresh)
    else:
        raise RuntimeError(f"points-to sets did not settle in {max_rounds} rounds")
    return settle(one.join(known, ["func", "rep"]).select("func", "node", "target").distinct())


def with_parents(pts: DataFrame) -> DataFrame:
    """Points-to sets in which a field such as ``_1.0.2`` also points where its parents ``_1.0`` and ``_1`` do."""
    parts = F.split("node", r"\.")
    up = pts.select("func", "node").distinct().withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    return up.join(pts.select("func", F.col("node").alias("up"), "target"), ["func", "up"]).select("func", "node", "target").distinct()


def field_copies(places: DataFrame) -> DataFrame:
    """Copy constraints from a place (func, node) to the places of its fields, however deep.

    Every place looks its prefixes up, of which it has as many as fields, so no two places of a local are compared."""
    parts = F.split("node", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    known = places.select("func", "node").distinct()
    up = known.where(F.size(parts) > 1).select("func", F.explode(prefixes).alias("src"), F.col("node").alias("dst"))
    return up.join(known.withColumnRenamed("node", "src"), ["func", "src"], "left_semi").select("func", "src", "dst", F.lit("AliasCopy").alias("kind"))


def constraints_of(statements: DataFrame) -> DataFrame:
    """Constraints of assignments (func, lhs, lhs_deref, rvalue, operand, operand_deref): a reference is Address, a dereference on the
    left Store, on the right Load, else Copy."""
    kind = F.when(F.col("rvalue") == "ref", "Address").when(F.col("lhs_deref"), "Store").when(F.col("operand_deref"), "Load").otherwise("Copy")
    return statements.where("operand is not null").select("func", F.col("operand").alias("src"), F.col("lhs").alias("dst"), kind.alias("kind"))


def call_constraints(calls: DataFrame) -> DataFrame:
    """Constraints of calls (func, callee, dest, args): every argument copies to the destination; an index call copies its first
    argument only; an atomic pointer's store stores its second argument through the first."""
    ptr, idx = F.col("callee").rlike(r"AtomicPtr(::<.*>)?::store$"), F.col("callee").rlike(r"::index(_mut)?$")
    store = calls.where(ptr).select("func", F.col("args")[1].alias("src"), F.col("args")[0].alias("dst"), F.lit("Store").alias("kind"))
    rest = calls.where(~ptr & F.col("dest").isNotNull()).select("func", F.explode(F.when(idx, F.slice("args", 1, 1)).otherwise(F.col("args"))).alias("src"), F.col("dest").alias("dst"), F.lit("Copy").alias("kind"))
    return store.union(rest)


def aliases(pts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (func, a, b) with ``kind``: Probably if the sets meet, Unlikely if not, Unknown where either is missing."""
    nodes = pts.select("func", "node").distinct()
    has = lambda c: nodes.select("func", F.col("node").alias(c), F.lit(True).alias(f"has_{c}"))
    x = pts.select("func", F.col("node").alias("a"), "target")
    y = pts.select("func", F.col("node").alias("b"), "target")
    meets = pairs.select("func", "a", "b").distinct().join(x, ["func", "a"]).join(y, ["func", "b", "target"], "left_semi").select("func", "a", "b").distinct().withColumn("meets", F.lit(True))
    out = pairs.join(has("a"), ["func", "a"], "left").join(has("b"), ["func", "b"], "left").join(meets, ["func", "a", "b"], "left")
    return out.select("func", "a", "b", F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "Unknown").when(F.col("meets"), "Probably").otherwise("Unlikely").alias("kind"))


def all_alias_links(pts: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """Star edges (func, a, b) that join all nodes (of ``some`` (func, node), if given) that point to a common target: each to the target's least node,
    so a target that very many nodes point to makes no quadratic number of pairs."""
    p = pts if some is None else pts.join(some.select("func", "node"), ["func", "node"], "left_semi")
    least = p.groupBy("func", "target").agg(F.min("node").alias("a"))
    return p.join(least, ["func", "target"]).where("node != a").select("func", "a", F.col("node").alias("b")).distinct()


def interprocedural(facts: DataFrame) -> DataFrame:
    """The strongest kind of each pair: ``facts`` (a, b, evidence) with evidence constant, parameter or none; a constant in common is Probably,
    parameters of one type and projection Possibly, else Unlikely."""
    kind = F.when(F.col("evidence") == "constant", "Probably").when(F.col("evidence") == "parameter", "Possibly").otherwise("Unlikely")
    rank = F.create_map(*[F.lit(x) for kv in ALIAS_RANK.items() for x in kv])
    return facts.select("a", "b", kind.alias("kind")).groupBy("a", "b").agg(F.max_by("kind", rank[F.col("kind")]).alias("kind"))


def report(pts: DataFrame) -> DataFrame:
    """(func, node, n, targets): sets with two targets or more first by kind of node (allocation, place, constant), then by name."""
    rank = F.when(F.col("node").startswith("Alloc("), 0).when(F.col("node").startswith("const"), 2).otherwise(1)
    return pts.groupBy("func", "node").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("target")).alias("targets")).orderBy("func", rank, "node")
