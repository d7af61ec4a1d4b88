"""Centroid clustering by plain Lloyd rounds, in integers from end to end.

The centroids are the only thing that goes to every task, and there are ``k`` of them.  Each round reads the vectors, takes in NumPy
the integer squared differences to each centroid, and gives for each task and cluster the sums of the components and the number
of vectors; those meet in a ``groupBy``.  Sums travel as digits of 32 bits, so no sum can run over, however many rows there are.

Defined results: vectors that are null, have another number of components than ``dim``, or hold a null or non-finite
component take no part and have no row.  Each component x counts as floor(scale * x), x as double.  The centroids start as the ``k``
kept vectors with the smallest lowercase-hex sha256 of ``1:<id>``, in ascending order; rows with one hash start in the order of their
components, and a row without an id comes after all others.  A vector belongs to the nearest centroid, of equally near ones to the
smallest number.  Repeated rows count each.  Fewer vectors than ``k`` give as many centroids; an empty table gives an
empty result.  Components may be of any finite size: they are counted exactly, and a distance or an inertia that a long can't
hold is null.  Other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.staging import stage

#: Components of this size or less, of which there are up to 2**6, have squared distances that a long holds.
SMALL = 1 << 27
LONG = 1 << 63


def kept_vectors(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of ``dim`` finite components, as doubles."""
    v = vectors[vector_col].cast("array<double>")
    whole = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))


def integers(batch: pd.Series, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, or Python's where one is large."""
    x = np.stack(batch.to_list()).astype(float) if len(batch) else np.zeros((0, dim))
    if x.size == 0 or np.abs(x).max() * scale <= SMALL:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(y) * scale if y.is_integer() else math.floor(y * scale) for y in x.ravel().tolist()]  # a product may overflow only where y is an integer
    return np.array(exact, object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centroid, the smallest of equally near ones, and the squared distance."""
    small = x.dtype != object and x.shape[1] <= 64 and all(abs(c) <= SMALL for row in centroids for c in row)
    x = x if small else x.astype(object)
    far = np.empty((len(x), len(centroids)), x.dtype)
    for k, row in enumerate(centroids):
        gap = x - np.array(row, x.dtype)
        far[:, k] = (gap * gap).sum(axis=1)
    best = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
    return best, far[np.arange(len(far)), best]


def _digits(n: int) -> list[int]:
    """An integer in base 2**32, least digit first; the last one has the sign."""
    out = []
    while not -(1 << 31) <= n < 1 << 31:
        out.append(n & 0xFFFFFFFF)
        n >>= 32
    return [*out, n]


def _round(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: each the floor of the mean of its vectors; empty ones stay."""
    dim = len(centroids[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
        for batch in batches:
            x = integers(batch["v"], scale, dim)
            best, _ = nearest(x, centroids)
            for k in np.unique(best).tolist():
                mine = x[best == k]
                counts[k] += len(mine)
                sums[k] = [a + int(b) for a, b in zip(sums[k], mine.sum(axis=0), strict=True)]
        rows = [(k, j, d, digit) for k, n in enumerate(counts) if n for j, s in enumerate([*sums[k], n]) for d, digit in enumerate(_digits(s))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "digit", "part"]).astype({"cluster": "int32", "component": "int32", "digit": "int32", "part": "int64"})

    parts = kept.select("v").mapInPandas(run, "cluster int, component int, digit int, part long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "digit").agg(F.sum("part").alias("part")).collect():  # k * (dim + 1) numbers of a few digits
        total[r["cluster"], r["component"]] = total.get((r["cluster"], r["component"]), 0) + (r["part"] << (32 * r["digit"]))
    return [[total[k, j] // total[k, dim] for j in range(dim)] if (k, dim) in total else row for k, row in enumerate(centroids)]


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector, staged, and the final centroids."""
    kept = kept_vectors(vectors, dim, id_col, vector_col)
    by = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(by.asc_nulls_last(), "v").limit(k).collect()
    start = [row.tolist() for row in integers(pd.Series([np.array(r["v"]) for r in first], dtype=object), scale, dim)]
    centroids = start
    for _ in range(rounds if start else 0):
        centroids = _round(kept, centroids, scale)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, far = nearest(integers(batch["v"], scale, dim), centroids)
            far = pd.Series(far, dtype="int64") if far.dtype != object else pd.Series([int(d) if d < LONG else None for d in far], dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype(np.int32), "distance": far})

    # ids go through pandas as text: with nulls among them it would make them doubles
    placed = kept.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(assign, "vec_id string, cluster int, distance long")
    return stage(placed.select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance"), "clusters"), centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components joined by commas)."""
    placed, centroids = lloyd(vectors, k, rounds, scale, dim, id_col, vector_col)
    exact = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in placed.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda n: n if n is not None and n < LONG else None
    whole = fits(None if None in sums.values() else sum(sums.values()))
    about = [(c, fits(sums.get(c)), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    of = placed.sparkSession.createDataFrame(about, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), F.col("cluster") == F.col("of")).drop("of")
