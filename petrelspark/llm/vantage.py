"""Nearest neighbours by vantage-point trees, one for each shard, with pruning by the triangle inequality.

Vectors go to the nearest of a bounded number of pivots, and a pivot's vectors to shards of bounded size, so a vector that
a third of all rows repeat fills many shards and no task.  A task builds the tree of a shard at a time and asks it for blocks of
queries.  Every query first asks the shard that it lies in; what it finds there bounds the search, and it goes on only to the pivots whose ball
can hold something as near, and there only into branches that can.  ``factor`` stretches the distance that a branch or ball
is known to keep: 1 prunes nothing that could matter, so the search is exact; above 1 it prunes more and may miss.

Distances are Euclidean in double precision, with the squares added from the first component to the last; matrix products only tell
which pairs need them.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, and rows without an id take no part.  A
vector only meets those with as many components.  Rows that repeat an id and its vector count once; different vectors under one id are
candidates and queries each, and rows of a query's own id are none of its candidates.  Of equally near candidates the smaller id
is nearer, and one (id, distance) of several vectors counts once for each.  An empty table gives an empty result.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petrelspark.staging import stage

#: Vectors in a leaf; pivots at most; queries that a copy of a shard answers, about.
LEAF, MOST_PIVOTS, QUERIES_PER_COPY = 128, 1024, 32_768
NOBODY = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as floats where they are floats, else as doubles."""
    v = vectors[vector_col].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0)
    kept = vectors[vector_col] if dict(vectors.dtypes)[vector_col] == "array<float>" else v
    return vectors.where(F.coalesce(finite, F.lit(False)) & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), kept.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equally many numbers as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows: squares added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        total += gap * gap
    return np.sqrt(total)


@dataclass
class Tree:
    """A node: the rows of a leaf, or a vantage point and for each side the least and largest distance from it."""

    rows: np.ndarray | None = None
    point: np.ndarray | None = None
    sides: list[tuple[float, float, Tree]] = field(default_factory=list)


def build(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of some rows of ``x``: the vantage point is the row furthest from their mean, and the median distance parts them."""
    if len(rows) <= leaf:
        return Tree(rows=rows)
    here = x[rows]
    point = here[np.sqrt(((here - here.mean(axis=0)) ** 2).sum(axis=1)).argmax()]
    far = np.sqrt(((here - point) ** 2).sum(axis=1))
    order = np.argsort(far, kind="stable")
    half = len(order) // 2
    sides = [order[:half], order[half:]]
    return Tree(point=point, sides=[(float(far[s].min()), float(far[s].max()), build(x, rows[s], leaf)) for s in sides])


class Search:
    """The nearest rows of a shard for a block of queries; ``bound``: the distance beyond which none is wanted, of each query."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, tree: Tree, k: int, factor: float):
        self.x, self.ids, self.tree, self.k, self.factor = x, ids, tree, k, factor
        self.norms = (x * x).sum(axis=1)

    def run(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), each with k columns, infinite where there are fewer."""
        self.q, self.own, self.given = q, own, bound
        self.squares = (q * q).sum(axis=1)
        self.best, self.who = np.full((len(q), self.k), np.inf), np.full((len(q), self.k), NOBODY)
        first: dict[int, np.ndarray] = {}
        self._down(self.tree, np.flatnonzero(np.isinf(bound)), first)
        self._walk(self.tree, np.arange(len(q)), first)
        return self.best, self.who

    def _limit(self, active: np.ndarray) -> np.ndarray:
        return np.minimum(self.given[active], self.best[active, -1])

    def _down(self, node: Tree, active: np.ndarray, first: dict[int, np.ndarray]) -> None:
        """Queries without a bound ask the leaf on their side of each vantage point first."""
        if not len(active):
            return
        if node.rows is not None:
            first[id(node)] = active
            self._leaf(node.rows, active)
            return
        far = distances(self.q[active], np.broadcast_to(node.point, (len(active), self.q.shape[1])))
        inner = far <= (node.sides[0][1] + node.sides[1][0]) / 2
        for side, mine in zip(node.sides, (inner, ~inner), strict=True):
            self._down(side[2], active[mine], first)

    def _walk(self, node: Tree, active: np.ndarray, first: dict[int, np.ndarray]) -> None:
        if node.rows is not None:
            self._leaf(node.rows, np.setdiff1d(active, first[id(node)], assume_unique=True) if id(node) in first else active)
            return
        far = distances(self.q[active], np.broadcast_to(node.point, (len(active), self.q.shape[1])))
        sides = sorted(node.sides, key=lambda s: float(np.abs(far - (s[0] + s[1]) / 2).sum()))  # the nearer side of most first
        for least, most, child in sides:
            on = near_enough(far, least, most, self._limit(active), self.factor)
            if on.any():
                self._walk(child, active[on], first)

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        if not len(active):
            return
        limit = self._limit(active)
        # about the squared distance: a pair surely beyond the limit is left out, and all others are measured
        rough = self.squares[active][:, None] + self.norms[rows][None, :] - 2.0 * (self.q[active] @ self.x[rows].T)
        slack = 1e-9 * (self.squares[active][:, None] + self.norms[rows][None, :])
        with np.errstate(over="ignore", invalid="ignore"):
            a, b = np.nonzero(~(rough > limit[:, None] ** 2 * (1 + 1e-9) + slack) & (self.ids[rows][None, :] != self.own[active][:, None]))
        far = distances(self.q[active[a]], self.x[rows[b]])
        keep = far <= limit[a]
        a, b, far = a[keep], b[keep], far[keep]
        if not len(a):
            return
        ids = self.ids[rows[b]]
        order = np.lexsort((ids, far, a))
        a, far, ids = a[order], far[order], ids[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        top = rank < self.k
        a, far, ids, rank = a[top], far[top], ids[top], rank[top]
        new_far, new_ids = np.full((len(active), self.k), np.inf), np.full((len(active), self.k), NOBODY)
        new_far[a, rank], new_ids[a, rank] = far, ids
        hit = np.unique(a)
        both, who = np.hstack([self.best[active[hit]], new_far[hit]]), np.hstack([self.who[active[hit]], new_ids[hit]])
        order = np.lexsort((who, both), axis=-1)[:, : self.k]
        self.best[active[hit]], self.who[active[hit]] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)


def near_enough(far: np.ndarray, least: float, most: float, limit: np.ndarray, factor: float) -> np.ndarray:
    """If what lies between ``least`` and ``most`` from a point can be within ``limit`` of a query that is ``far`` from it; the
    distance that the triangle inequality keeps counts ``factor`` times."""
    kept = np.maximum(np.maximum(far - most, least - far), 0.0)
    return ~(kept * factor > limit + 1e-9 * (far + most))


KEY = ["dim", "cell", "part", "copy"]
ANSWER = "dim long, cell long, part long, query long, query_id long, v array<double>, bound double, found array<struct<vec_id:long,score:double>>"


def _asked(rows: DataFrame, k: int, factor: float) -> DataFrame:
    """The answers of each shard (``KEY``) to its queries.

    A shard's members come before its guests, so a task holds one tree and one batch of queries at a time.  Members that ask have no
    bound yet; guests have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, asking, tree = None, [], [], None

        def grown() -> Search:
            x, ids = np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members])
            once = np.unique(np.hstack([ids[:, None].view(float), x]).view(f"V{8 * (x.shape[1] + 1)}").ravel(), return_index=True)[1]  # an id and its vector count once
            once = once[np.argsort(ids[once], kind="stable")]
            return Search(x[once], ids[once], build(x[once], np.arange(len(once))), k, factor)

        def answer(key: tuple, tree: Search, q: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(q), 1024):
                some = slice(lo, lo + 1024)
                best, who = tree.run(q[some], ids[some], bound[some])
                n = len(best)
                counts = np.isfinite(best).sum(axis=1)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                full = np.isfinite(best)
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(who[full]), pa.array(best[full])], ["vec_id", "score"]))
                vectors = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * q.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(q[some]).ravel()))
                names = [hash_of(i, v) for i, v in zip(ids[some].tolist(), q[some], strict=True)]
                columns = [*[pa.array(np.full(n, c)) for c in key[:3]], pa.array(names, pa.int64()), pa.array(ids[some]), vectors, pa.array(np.minimum(best[:, -1], bound[some])), found]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "part", "query", "query_id", "v", "bound", "found"])

        def finish() -> Iterator[pa.RecordBatch]:
            """The members of a shard that ask."""
            if members and any(a.any() for a in asking):
                s = tree or grown()
                ask = np.zeros(len(s.ids), bool)
                wanted = np.unique(np.concatenate([m[1][a] for m, a in zip(members, asking, strict=True)]))
                ask[np.isin(s.ids, wanted)] = True
                yield from answer(at, s, s.x[ask], s.ids[ask], np.full(int(ask.sum()), np.inf))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY])
            member = batch.column("member").to_numpy(zero_copy_only=False)
            marks = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (member[1:] != member[:-1])) + 1
            for lo, hi in zip([0, *marks.tolist()], [*marks.tolist(), batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = tuple(keys[:, lo].tolist())
                if key != at:
                    yield from finish()
                    at, members, asking, tree = key, [], [], None
                some = batch.slice(lo, hi - lo)
                x, ids = matrix(some.column("v")), some.column("vec_id").to_numpy()
                if member[lo]:
                    members.append((x, ids))
                    asking.append(some.column("asks").to_numpy(zero_copy_only=False))
                elif members:
                    tree = tree or grown()
                    yield from answer(key, tree, x, ids, some.column("bound").to_numpy())
        yield from finish()

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, F.col("member").desc())
    return dealt.mapInArrow(run, ANSWER)


def hash_of(query_id: int, v: np.ndarray) -> int:
    """Tells apart queries of one id with different vectors."""
    return int.from_bytes(hashlib.blake2b(query_id.to_bytes(8, "little", signed=True) + v.tobytes(), digest_size=8).digest(), "little", signed=True)


def search(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, per_shard: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row for which ``queries``, a condition on ``vec_id``, holds.

    ``factor`` 1 is exact; above it branches are pruned more freely.  ``per_shard``: about the vectors of a tree.  Pivots are a bounded sample
    (``MOST_PIVOTS`` at most, by the hash of the id); every row is in a tree."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    every = rows.agg(F.count("*")).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "v").limit(min(MOST_PIVOTS, max(1, -(-every // per_shard)))).collect()
    pivots = list(dict.fromkeys(tuple(r["v"]) for r in sample))
    of_dim = {d: ([n for n, p in enumerate(pivots) if len(p) == d], np.array([p for p in pivots if len(p) == d])) for d in {len(p) for p in pivots}}

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy()).astype(np.int64)
            cell, gap = np.full(len(sizes), -1), np.zeros(len(sizes))
            for d in np.unique(sizes).tolist():
                if d in of_dim:
                    at = np.flatnonzero(sizes == d)
                    numbers, points = of_dim[d]
                    x = matrix(batch.column("v").take(pa.array(at)))
                    best = ((points * points).sum(axis=1)[None, :] - 2.0 * (x @ points.T)).argmin(axis=1)
                    cell[at], gap[at] = np.array(numbers)[best], distances(x, points[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(cell), pa.array(gap)], ["vec_id", "v", "asks", "dim", "cell", "gap"])

    kind = dict(rows.dtypes)["v"]
    asks = F.coalesce(queries, F.lit(False)).alias("asks")
    placed = stage(rows.select("vec_id", "v", asks).mapInArrow(nearest_pivot, f"vec_id long, v {kind}, asks boolean, dim long, cell long, gap double"), "placed")
    # of each cell the vectors, and the least and largest distance from its pivot; a cell without a pivot (-1) is never pruned
    about = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most")).collect()
    cells = {(r["dim"], r["cell"]): (-(-r["n"] // per_shard), r["least"], r["most"]) for r in about}
    parts = spark.createDataFrame([(*c, n) for c, (n, _, _) in cells.items()], "dim long, cell long, parts long")
    shards = placed.join(F.broadcast(parts), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).alias("part"), "vec_id", F.col("v").cast("array<double>").alias("v"), "asks")
    number, no_bound = F.lit(0).cast("long"), F.lit(math.inf)
    home = stage(_asked(shards.select("dim", "cell", "part", number.alias("copy"), "vec_id", "v", "asks", no_bound.alias("bound"), F.lit(True).alias("member")), k, factor), "home")

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other shards that a query has to ask."""
        for batch in batches:
            out = []
            for dim, cell, part, query, v, bound in zip(*[batch.column(c).to_pylist() for c in ("dim", "cell", "part", "query_id", "v", "bound")], strict=True):
                numbers, points = of_dim.get(dim, ([], np.zeros((0, dim))))
                far = dict(zip(numbers, distances(points, np.broadcast_to(np.array(v), points.shape)).tolist(), strict=True))
                for (d, c), (n, least, most) in cells.items():
                    if d == dim and (c < 0 or near_enough(np.array([far[c]]), least, most, np.array([bound]), factor)[0]):
                        out += [(dim, c, p, query, v, bound) for p in range(n) if (c, p) != (cell, part)]
                if len(out) >= 1024:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    asking = stage(home.select("dim", "cell", "part", "query_id", "v", "bound").mapInArrow(onward, "dim long, cell long, part long, vec_id long, v array<double>, bound double"), "asking")
    # a shard that very many ask has copies, each with some of the queries
    shard = KEY[:3]
    asked = asking.groupBy(*shard).count().select(*shard, F.ceil(F.col("count") / QUERIES_PER_COPY).alias("copies"))
    copy = F.explode(F.sequence(number, F.col("copies") - 1)).alias("copy")
    members = shards.join(asked, shard).select(*shard, copy, "vec_id", "v", F.lit(False).alias("asks"), no_bound.alias("bound"), F.lit(True).alias("member"))
    guests = asking.join(asked, shard).select(*shard, F.pmod(F.xxhash64("vec_id"), F.col("copies")).alias("copy"), "vec_id", "v", F.lit(True).alias("asks"), "bound", F.lit(False).alias("member"))
    answers = [home, _asked(members.unionByName(guests), k, factor)]
    found = answers[0].select("query", "query_id", F.inline("found")).unionByName(answers[1].select("query", "query_id", F.inline("found")))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["dim", "cell", "part", "vec_id", "v", "bound"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
