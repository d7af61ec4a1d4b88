"""What functions do to what they are given: parameters that flow into other parameters or into the result.

A function's summary is what its parameters reach by its copies; at a call the callee's summary takes the arguments' place, so it gives further copies
to the caller, and so on until no call gives a new one.  Nothing is inlined and no path is listed: what meets are summaries, of which a
function has at most as many as pairs of parameters, and call sites.  Only functions with new copies are looked at again, and calls of functions with new summaries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.operators.closure import reachable
from petrelspark.staging import settle

#: The place of a function's result.
RESULT = "_0"


#: Copies and parameters of a function that may meet in a row.
MOST = 256


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (func, edges), in which an edge without an end names a parameter: what each parameter leads to among parameters and result."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(k, 64).to_pylist():
                ahead = defaultdict(list)
                for e in row["edges"]:
                    ahead[e["src"]].append(e["dst"])
                sources = {a for a, to in ahead.items() if None in to}
                for source in sources:
                    seen, work = {source, None}, [source]
                    while work:
                        fresh = set(ahead.get(work.pop(), ())) - seen
                        seen |= fresh
                        work.extend(fresh)
                    out.extend((row["func"], source, goal) for goal in seen & (sources | {RESULT}) if goal != source)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["func", "source", "goal"])


def within(edges: DataFrame, parameters: DataFrame, most: int = MOST) -> DataFrame:
    """(func, source, goal) by each function's own edges (func, src, dst) from its parameters (func, local).

    What a function has meets in a row; functions with more than ``most`` take rounds over all executors."""
    rows = settle(edges.unionByName(parameters.select("func", F.col("local").alias("src"), F.lit(None).cast("string").alias("dst"))))
    large = settle(rows.groupBy("func").count().where(F.col("count") > most).select("func"))
    small = rows.join(large, "func", "left_anti").groupBy("func").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    found = small.mapInArrow(_flows, "func string, source string, goal string")
    if large.isEmpty():
        return found
    rest = settle(rows.join(large, "func", "left_semi"))
    sources = rest.where("dst is null").select("func", F.col("src").alias("goal"))
    to = reachable(rest.where("dst is not null"), sources.select("func", F.col("goal").alias("root"), F.col("goal").alias("node")), ["func"])
    goals = sources.union(sources.select("func", F.lit(RESULT))).distinct()
    met = to.where("node != root").select("func", F.col("root").alias("source"), F.col("node").alias("goal")).join(goals, ["func", "goal"], "left_semi")
    return found.unionByName(met.select("func", "source", "goal"))


def summaries(copies: DataFrame, calls: DataFrame, parameters: DataFrame, max_rounds: int = 10_000, most: int = MOST) -> DataFrame:
    """(func, source, goal): the parameters ``source`` that reach another parameter or the result (``_0``).

    ``copies``: (func, src, dst); ``calls``: (func, callee, args, dest), of which the k-th argument is parameter ``_k`` of the callee and null arguments lead
    nowhere; ``parameters``: (func, local).  Rows with a null end are left out.  ``most``: as in ``within``."""
    edges = settle(copies.select("func", "src", "dst").where("func is not null and src is not null and dst is not null and src != dst").distinct())
    own = settle(parameters.select("func", "local").where("func is not null and local is not null").distinct())
    # of each call the place of each parameter, and of the result
    spots = F.concat(F.transform("args", lambda a, i: F.struct(F.concat(F.lit("_"), (i + 1).cast("string")).alias("inner"), a.alias("outer"))), F.array(F.struct(F.lit(RESULT).alias("inner"), F.col("dest").alias("outer"))))
    sites = settle(calls.select("func", F.col("callee").alias("of"), F.map_from_entries(spots).alias("outer")).where("func is not null and of is not null"))
    done = found = settle(within(edges, own, most))
    for step in range(1, max_rounds + 1):
        at = lambda c: F.try_element_at("outer", F.col(c))
        given = sites.join(done.withColumnRenamed("func", "callee"), F.col("of") == F.col("callee")).select("func", at("source").alias("src"), at("goal").alias("dst"))
        made = given.where("src != dst").distinct()
        made = settle(made.join(edges, ["func", "src", "dst"], "left_anti"))
        if made.isEmpty():
            return found
        edges = edges.union(made)
        if step % 16 == 0:
            edges, found = settle(edges), settle(found)
        changed = settle(made.select("func").distinct())
        # only functions with new copies are looked at again
        now = within(edges.join(changed, "func", "left_semi"), own.join(changed, "func", "left_semi"), most)
        done = settle(now.join(found, ["func", "source", "goal"], "left_anti"))
        found = found.union(done)
    raise RuntimeError(f"summaries did not settle in {max_rounds} rounds")


def parameter_aliases(found: DataFrame, calls: DataFrame) -> DataFrame:
    """(func, a, b): places of a caller that a call makes one lead to the other, from the callee's summary."""
    spots = F.concat(F.transform("args", lambda a, i: F.struct(F.concat(F.lit("_"), (i + 1).cast("string")).alias("inner"), a.alias("outer"))), F.array(F.struct(F.lit(RESULT).alias("inner"), F.col("dest").alias("outer"))))
    sites = calls.select("func", "callee", spots.alias("spots"))
    hit = sites.join(found.withColumnRenamed("func", "callee"), "callee")
    at = lambda c: F.try_element_at(F.transform(F.filter("spots", lambda s: s["inner"] == F.col(c)), lambda s: s["outer"]), F.lit(1))
    return hit.select("func", at("source").alias("a"), at("goal").alias("b")).where("a is not null and b is not null and a != b").distinct()
