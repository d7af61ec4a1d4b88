"""Neighbours, conversation tries and clusters against plain versions, on small tables with nulls, ties, repeats and odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrelspark.llm import lloyd, prefix_trie, vantage

VECTORS = "vec_id long, embedding array<float>, n string, cell string, distance string"


def vectors(n=700, dim=6, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 2) for _ in range(dim)] for _ in range(5)]
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(c + r.gauss(0, 0.4)) for c in centres[r.randrange(5)]]) for k in range(n)]
    same = [1.0] * dim
    rows += [(n + k, same) for k in range(300)]  # one vector for a third of the rows
    rows += [(5, rows[5][1]), (None, same), (2000, None), (2001, []), (2002, [0.0] * dim), (2003, [math.nan] * dim), (2004, [math.inf] + [0.0] * (dim - 1)), (2005, [None] + same[1:])]
    rows += [(2100, same[:3]), (2101, [0.5, 1.0, 1.0]), (-100, same), (-7, [x * 3 for x in same]), (1 << 62, rows[3][1])]
    return [(i, v, "x", "x", "x") for i, v in rows]


def measure(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def neighbours(rows, k, asked):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if asked(i):
            near = sorted((measure(v, w), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1): (j, d) for r, (d, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("per_shard", [40, 5000])
def test_exact_neighbours(spark, per_shard):
    rows = vectors()
    got = vantage.search(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 20 == 0, k=7, per_shard=per_shard).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == neighbours(rows, 7, lambda i: i % 20 == 0) and len(got) == len({(r["query_id"], r["rank"]) for r in got})


def test_relaxed_pruning_keeps_recall_and_visits_less():
    r = np.random.default_rng(1)
    x = np.concatenate([c + r.normal(0, 0.5, (500, 8)) for c in r.normal(0, 3, (8, 8))])
    ids, tree = np.arange(len(x)), vantage.build(x, np.arange(len(x)), 32)
    seen = {}
    for factor in (1.0, 1.5, 3.0):
        s = vantage.Search(x, ids, tree, 10, factor)
        measured, plain = [0], s._leaf
        s._leaf = lambda rows, active, m=measured, plain=plain: (m.__setitem__(0, m[0] + len(rows) * len(active)), plain(rows, active))
        best, who = s.run(x[::50], ids[::50], np.full(len(x[::50]), np.inf))
        seen[factor] = (who, measured[0])
    want = np.array([[j for j in np.lexsort((ids, vantage.distances(x, np.broadcast_to(q, x.shape)))) if j != i][:10] for i, q in zip(ids[::50], x[::50], strict=True)])
    recall = {f: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(w, want, strict=True)]) for f, (w, _) in seen.items()}
    assert recall[1.0] == 1 and recall[1.5] >= 0.9 and seen[3.0][1] < seen[1.0][1] < len(x) * len(x[::50])


def test_copies_of_shards(spark, monkeypatch):
    monkeypatch.setattr(vantage, "QUERIES_PER_COPY", 5)
    rows = vectors(200)
    got = vantage.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 7 == 0, k=3, per_shard=30).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == neighbours(rows, 3, lambda i: i % 7 == 0)


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vantage.search(none, F.col("vec_id") >= 0).count() == 0 and lloyd.clusters(none, dim=6).count() == 0
    only = spark.createDataFrame([(0, [1.0, 2.0], "", "", "")], VECTORS)
    assert vantage.search(only, F.col("vec_id") >= 0).count() == 0


def plain_lloyd(rows, k, rounds, scale, dim):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in start]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    of = lambda v: min((gap(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [[] for _ in centroids]
        for _, v in kept:
            mine[of(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(mine, centroids, strict=True)]
    found = [(i, *of(v)) for i, v in kept]
    fits = lambda n: n if n < 1 << 63 else None
    sums = {c: sum(d for _, d, x in found if x == c) for _, _, c in found}
    return sorted([(i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found], key=str)


@pytest.mark.parametrize("big", [False, True])
def test_clusters(spark, big):
    rows = vectors(300) + [(9000, [-0.25] * 6, "", "", "")] + ([(9001, [float(np.float32(3.0e38))] * 6, "", "", ""), (9002, [float(np.float32(-1.0e12))] * 6, "", "", "")] if big else [])
    got = lloyd.clusters(spark.createDataFrame(rows, VECTORS).repartition(4), k=16, rounds=3, scale=64, dim=6)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_lloyd(rows, 16, 3, 64, 6)


def test_fewer_vectors_than_centroids(spark):
    rows = [(k, [float(k), 0.0], "", "", "") for k in range(3)] + [(1, [1.0, 0.0], "", "", "")]
    got = lloyd.clusters(spark.createDataFrame(rows, VECTORS), k=16, rounds=2, dim=2)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_lloyd(rows, 16, 2, 64, 2)


TURNS = "conv_id long, turn long, role string, text string, digest string, pos string, block string"


def conversations(seed=2, n=120):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", "é😀", None, "long " * 9])) for c in range(n) for t in range(r.choice([1, 2, 3, 9, 12]))]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 290) for t in range(14)]  # copies, three quarters of them whole
    rows += [(400, t, "user", f"very long {t % 3}") for t in range(60)] + [(401, None, "user", "null turn"), (401, 0, "user", "zero"), (402, 5, "a", "tie"), (402, 5, "b", "tie"), (402, 5, "a", "tie"), (-7, 1, "u", "negative"), (-5, 1, "u", "base"), (None, 1, "u", "nobody")]
    r.shuffle(rows)
    return [(*x, "clash", "clash", "clash") for x in rows]


def plain_trie(rows, family=5, heads=9):
    said = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", said(role or "", text or ""), text or ""))
    own = {c: [(role, text) for *_, role, _, text in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:]
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted([(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items()], key=str)


@pytest.mark.parametrize("block", [4, 256])
def test_trie(spark, block):
    rows = conversations()
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS).repartition(5), block=block).drop("digest").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_trie(rows)


def test_small_tries(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = [(1, 0, "u", "t", "", "", "")]  # h of 1 is 7 or so: what it says itself goes, and there is no conversation 0
    got = prefix_trie.trie(spark.createDataFrame(turnless, TURNS)).drop("digest").collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_trie(turnless)


def test_ids_are_joined_in_pieces(spark):
    ends = [(1, b"a", c) for c in range(-50, 500)] + [(1, b"b", 3), (2, b"a", 4)]
    got = prefix_trie.end_digests(spark.createDataFrame(ends, "depth long, digest binary, conv_id long").repartition(3), most=64).collect()
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {(r["depth"], bytes(r["digest"])): r["ends_sha256"] for r in got} == {(1, b"a"): sha(range(-50, 500)), (1, b"b"): sha([3]), (2, b"a"): sha([4])}
