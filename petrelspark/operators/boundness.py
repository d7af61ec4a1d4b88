"""Coverability trees, boundedness, and place and transition invariants.

The tree grows a level at a time for any number of nets; each node carries the markings on its path, as coverability compares a
marking with its own ancestors.  A null element of a marking is ω.  Invariants are exact rational null spaces: one small matrix
for each set of nets that share it, for which no DataFrame form is sensible.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.functions import markings as M
from petrelspark.operators.elimination import by_shape
from petrelspark.plans.net import Net
from petrelspark.staging import settle


def coverability(net: Net, limit: int = 10_000) -> DataFrame:
    """(net_id, depth, marking, path, cut): nodes of the tree of each net.  ``cut``: the net has more than ``limit`` nodes.  Capacities are not looked at."""
    firing = settle(net.firing()).withColumnRenamed("net_id", "of")
    start = net.initial().select("net_id", F.lit(0).alias("depth"), "marking", F.array("marking").alias("above"), F.array().cast("array<int>").alias("path"))
    front = nodes = settle(start)
    depth = 0
    over = front.where("false").select("net_id")
    while not front.isEmpty():
        depth += 1
        # ω never runs out
        enabled = F.forall(F.zip_with("marking", "pre", lambda m, w: m.isNull() | (m >= w)), lambda x: x)
        after = F.zip_with(F.zip_with("marking", "pre", lambda m, w: m - w), "post", lambda m, w: m + w)
        step = front.join(firing, F.col("net_id") == F.col("of")).where(enabled).withColumn("after", after)
        grown = F.aggregate("above", F.col("after"), lambda m, a: F.when(M.strictly_covers(m, a), M.accelerated(m, a)).otherwise(m))
        step = step.withColumn("m2", grown).withColumn("old", F.exists("above", lambda a: M.covers(a, F.col("m2")) & M.covers(F.col("m2"), a)))
        made = settle(step.select("net_id", F.lit(depth).alias("depth"), F.col("m2").alias("marking"), F.concat("above", F.array("m2")).alias("above"), F.concat("path", F.array("trans_id")).alias("path"), "old"))
        nodes = nodes.union(made.drop("old"))
        full = settle(nodes.groupBy("net_id").count().where(F.col("count") > limit).select("net_id"))
        over = over.union(full)
        front = settle(made.where("not old").drop("old").join(full, "net_id", "left_anti"))
    cut = over.distinct().withColumn("cut", F.lit(True))
    return nodes.drop("above").join(cut, "net_id", "left").na.fill(False, ["cut"])


def boundedness(net: Net, limit: int = 10_000) -> DataFrame:
    """(net_id, place_id, verdict, bound, witness): Bounded with the most tokens, Unbounded with the shortest path, then least, that pumps the place, or Unknown beyond the limit."""
    tree = settle(coverability(net, limit))
    ids = net.places.groupBy("net_id").agg(F.array_sort(F.collect_list("place_id")).alias("ids"))
    at = tree.join(ids, "net_id").select("net_id", "cut", "path", F.posexplode("marking").alias("pos", "n"), "ids").withColumn("place_id", F.element_at("ids", F.col("pos") + 1))
    w = F.min(F.when(F.col("n").isNull(), F.struct(F.size("path").alias("k"), "path"))).alias("w")
    each = at.groupBy("net_id", "place_id").agg(F.max("n").alias("most"), w, F.max("cut").alias("cut"))
    verdict = F.when(F.col("w").isNotNull(), "Unbounded").when(F.col("cut"), "Unknown").otherwise("Bounded")
    return each.select("net_id", "place_id", verdict.alias("verdict"), F.when(verdict == "Bounded", F.col("most")).alias("bound"), F.col("w.path").alias("witness"))


def null_space(rows: list[list[int]], n: int) -> list[list[int]]:
    """A basis of the integer vectors x of length n with rows·x = 0, each with coprime entries and its last pivot positive."""
    m = [[Fraction(x) for x in r] for r in rows]
    pivots: list[int] = []
    k = 0
    for c in range(n):
        best = next((i for i in range(k, len(m)) if m[i][c]), None)
        if best is None:
            continue
        m[k], m[best] = m[best], m[k]
        head = m[k][c]
        m[k] = [x / head for x in m[k]]
        for i in range(len(m)):
            if i != k and (f := m[i][c]):
                m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
        pivots.append(c)
        k += 1
    out = []
    for c in (c for c in range(n) if c not in pivots):
        v = [Fraction(0)] * n
        v[c] = Fraction(1)
        for i, p in enumerate(pivots):
            v[p] = -m[i][c]
        scale = lcm(*(x.denominator for x in v))
        ints = [int(x * scale) for x in v]
        common = gcd(*ints)
        out.append([x // common for x in ints])
    return out


def invariants(net: Net) -> DataFrame:
    """(net_id, kind, number, vector): a basis of place invariants (x·C = 0) and of transition invariants (C·y = 0), as text ``id:value``."""
    def solve(shapes):
        import pandas as pd

        for pdf in shapes:
            rows = []
            for name, shape in zip(pdf["of"], pdf["shape"], strict=True):
                places, trans = list(shape["places"]), list(shape["transitions"])
                cells: dict[tuple[int, int], int] = {}
                for x in shape["cells"]:
                    at = x["place_id"], x["trans_id"]
                    cells[at] = cells.get(at, 0) + int(x["change"])
                c = [[cells.get((x, y), 0) for y in trans] for x in places]
                found = [("place", places, null_space([list(col) for col in zip(*c, strict=True)] if c else [], len(places))), ("transition", trans, null_space(c, len(trans)))]
                rows.extend((name, kind, k, ",".join(f"{i}:{x}" for i, x in zip(ids, v, strict=True) if x)) for kind, ids, basis in found for k, v in enumerate(basis))
            yield pd.DataFrame(rows, columns=["net_id", "kind", "number", "vector"])

    parts = int(net.places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_shape(net, lambda shapes: shapes.repartition(parts).mapInPandas(solve, "net_id string, kind string, number long, vector string"))


def covered(net: Net) -> DataFrame:
    """(net_id, place_id, bound): places with a positive entry in a place invariant without negative ones; the invariant's tokens bound them."""
    x = invariants(net).where("kind = 'place'").select("net_id", "number", F.explode(F.split("vector", ",")).alias("x"))
    x = x.select("net_id", "number", F.substring_index("x", ":", 1).cast("int").alias("place_id"), F.substring_index("x", ":", -1).cast("long").alias("v"))
    at = x.join(net.places.select("net_id", "place_id", "tokens"), ["net_id", "place_id"])
    whole = at.groupBy("net_id", "number").agg(F.sum(F.col("v") * F.col("tokens")).alias("weight"), F.min("v").alias("least")).where("least > 0")
    return at.join(whole, ["net_id", "number"]).groupBy("net_id", "place_id").agg(F.min(F.expr("weight div v")).alias("bound"))


def boundedness_with_invariants(net: Net, limit: int = 10_000) -> DataFrame:
    """(net_id, place_id, verdict, bound, witness) as ``boundedness``: places that an invariant covers are bounded by it, and the tree grows only for nets with others."""
    by = settle(covered(net))
    open_ = net.places.select("net_id", "place_id").join(by, ["net_id", "place_id"], "left_anti").select("net_id").distinct()
    part = Net(*(d.join(open_, "net_id", "left_semi") for d in (net.places, net.transitions, net.arcs)))
    tree = boundedness(part, limit).join(by.select("net_id", "place_id"), ["net_id", "place_id"], "left_anti")
    none = F.lit(None).cast("array<int>")
    return by.select("net_id", "place_id", F.lit("Bounded").alias("verdict"), "bound", none.alias("witness")).unionByName(tree)
