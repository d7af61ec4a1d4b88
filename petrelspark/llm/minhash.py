"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. One pass over the texts gives each document's number of shingles, a digest of its whole shingle set, and its band keys.
   Documents of equal sets are one class from here on, so copies are never paired.
2. In each bucket every class is a candidate of the bucket's smallest class only: as many edges as bucket members.  Which
   buckets have company is told by a bitmap of bounded size, so that most members never move.
3. Candidates are confirmed on full shingle sets, which are computed again from the texts of candidates alone; another
   bitmap keeps all other texts where they are.
4. Where a bucket still holds classes of different components, those that its star did not compare are compared as well, so
   the star loses no link between different texts that share a bucket.  A profile of each set (how many of its hashes fall
   into each of 256 ranges) bounds the intersection of two sets from above; only pairs whose bound allows the similarity
   leave the task that compares them, and big buckets are compared in blocks of bounded size.
5. Components come from confirmed links, and from ids that stand on rows of several classes.

The number of bands follows from the threshold, the rows of a band and ``miss``, the accepted probability that a pair
right at the threshold shares no bucket.  Shingles are compared by 64-bit hashes.

Defined results: words are maximal runs of other bytes than space and U+0009 to U+000D, with A-Z in lower case.  A text
with fewer words than a shingle has its whole word sequence as the one shingle; a null, empty or blank text has none and is
linked with nothing.  Rows that repeat an id are one document, whose texts all stand in its component, and it is linked if one
of its texts is; a null id joins the component of its copies but makes no links.  Texts of any length are read whole.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.llm import marks, words
from petrelspark.llm.columns import fresh, small_batches, texts, with_groups
from petrelspark.operators.components import connected_components
from petrelspark.staging import stage

_RNG = np.random.Generator(np.random.PCG64(977))
_ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles of all leaves that one verification group holds at most, unless one document has more.
GROUP_SHINGLES = 1_500_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 800


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts: dict[int, list[np.ndarray]] = {}
    done = 0
    n = len(column)
    for numbers, data, text_ends in words.pieces(column):
        low = words.LOWER[data]
        starts, ends, counts = words.split(low, text_ends)
        hashed = words.hashes(low, starts, ends)
        tops = np.cumsum(counts)
        for k, a, b in zip(numbers, (tops - counts).tolist(), tops.tolist(), strict=True):
            while done < k:  # no further chunk of an earlier text can come
                yield _set(parts.pop(done), size)
                done += 1
            parts.setdefault(k, []).append(hashed[a:b])
    while done < n:
        yield _set(parts.pop(done, []), size)
        done += 1


def _set(parts: list[np.ndarray], size: int) -> np.ndarray:
    h = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < size:
            return words.mix(np.array([len(h)], np.uint64) * _ODD[0] + np.sum(h * _ODD[1 : 1 + len(h)], dtype=np.uint64))
        n = len(h) - size + 1
        s = h[:n] * _ODD[32]
        for j in range(1, size):
            s = s + h[j : j + n] * _ODD[32 + j]
    return np.unique(words.mix(s))


@lru_cache(4)
def _plan(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower border of each bin, and for each bin the fixed order in which other bins are asked when it is empty."""
    edges = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
    rng = np.random.Generator(np.random.PCG64(31))
    return edges, np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a sorted set: the least hash of each of ``bins`` ranges; an empty range takes that of another
    range, found by a hash of the range's own number and the attempt, so that every full range is as likely."""
    edges, asked = _plan(bins)
    at = np.searchsorted(s, edges)
    full = np.diff(at, append=len(s)) > 0
    out = s[np.minimum(at, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        source = asked[empty[:, None], np.argmax(full[asked[empty]], axis=1)[:, None]][:, 0]
        out[empty] = out[source]
    return out


def band_keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, of its number and its part of the signature."""
    sig = signature(s, bands * rows).reshape(bands, rows)
    with np.errstate(over="ignore"):
        return words.mix((sig * _ODD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[63]).view(np.int64)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null: no shingle), bands, profile (null: a range has too many hashes to count in a byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            counts, digests, keys, profiles = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                counts.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(s, bands, rows) if len(s) else None)
                ranges = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)
                profiles.append(ranges.astype(np.uint8).tobytes() if ranges.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(profiles, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "profile"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, profile binary")


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have ``100 * intersection >= percent * union``.  ``pairs``: (a, b, nb), with b's set size.

    Leaves of one hub are dealt to groups of bounded total size, each with the hub's set."""
    hubs = stage(pairs.groupBy("a").agg(F.sum("nb").alias("all"), F.count("*").alias("n_leaves")).select(F.col("a").alias("hub"), F.ceil(F.col("all") / GROUP_SHINGLES).cast("long").alias("groups"), "n_leaves"), "hubs")
    leaves = with_groups(pairs, hubs, "a", "hub", "n_leaves", pairs.count()).select(F.col("b").alias("id"), "hub", F.pmod(F.xxhash64("b"), "groups").alias("part"), F.lit(False).alias("is_hub"))
    own = hubs.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    requests = stage(leaves.union(own), "requests")
    bits = marks.bits_for(requests.count())
    near = marks.marked(docs, F.xxhash64("doc_id"), stage(marks.bitmap(requests.select("id"), F.xxhash64("id"), bits), "wanted"), bits)
    asked = near.join(requests.hint("merge"), F.col("doc_id") == F.col("id")).select("text", "id", "hub", "part", "is_hub")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            binary = pa.array((s.tobytes() for s in shingle_sets(batch.column("text"), size)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "hub", "part", "is_hub")] + [binary], ["id", "hub", "part", "is_hub", "hashes"])

    def verify(table: pa.Table) -> pa.Table:
        is_hub = table.column("is_hub").to_pylist()
        ids, hashes = table.column("id").to_pylist(), table.column("hashes").to_pylist()
        found = set()
        for h in (np.frombuffer(x, np.uint64) for x, hub in zip(hashes, is_hub, strict=True) if hub):
            for i, x, hub in zip(ids, hashes, is_hub, strict=True):
                if not hub and i not in found:
                    s = np.frombuffer(x, np.uint64)
                    short, long = (s, h) if len(s) < len(h) else (h, s)
                    at = np.searchsorted(long, short)
                    both = int((long[np.minimum(at, len(long) - 1)] == short).sum()) if len(long) else 0
                    if both and 100 * both >= percent * (len(s) + len(h) - both):
                        found.add(i)
        hub_id = table.column("hub")[0].as_py() if table.num_rows else None
        return pa.table({"a": pa.array([hub_id] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return asked.mapInArrow(sets, "id long, hub long, part long, is_hub boolean, hashes binary").groupBy("hub", "part").applyInArrow(verify, "a long, b long")


def possible(rest: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, nb) of ``rest`` (key, rep, n, c, many) in one bucket of ``many`` with different ``c`` whose profiles (doc_id, profile) allow the similarity."""
    dealt = rest.withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", "rep", "n", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    known = profiles.join(rest.select(F.col("rep").alias("of")).distinct(), F.col("doc_id") == F.col("of")).groupBy("of").agg(F.when(F.count("*") == 1, F.any_value("profile")).alias("profile"))  # an id with several texts has no bound
    rows = dealt.join(known, F.col("rep") == F.col("of")).drop("of")

    def compare(table: pa.Table) -> pa.Table:
        rep, n, c, block = (table.column(k).to_numpy() for k in ("rep", "n", "c", "block"))
        raw = table.column("profile").to_pylist()
        profile = np.stack([np.frombuffer(x, np.uint8) if x is not None else np.full(256, 255, np.uint8) for x in raw])
        exact = np.array([x is not None for x in raw])
        across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        a, b, nb = [], [], []
        for i in range(len(rep) - 1):
            j = np.arange(i + 1, len(rep))
            j = j[(c[j] != c[i]) & ((block[j] != block[i]) if across else True)]
            top = np.minimum(n[j], n[i])
            both = exact[j] & exact[i]
            top[both] = np.minimum(profile[j[both]], profile[i]).sum(axis=1, dtype=np.int64)
            j = j[(100 + percent) * top >= percent * (n[j] + n[i])]
            a.append(np.minimum(rep[j], rep[i]))
            b.append(np.maximum(rep[j], rep[i]))
            nb.append(np.where(rep[j] > rep[i], n[j], n[i]))
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return pa.table({"a": join(a), "b": join(b), "nb": join(nb)})

    return rows.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long, nb long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links lead to, or its own), kept."""
    t = texts(docs, id_col=id_col, text_col=text_col)
    bands = bands_for(percent / 100, rows, miss)
    found = stage(features(t, size, bands, rows), "minhash")
    classes = stage(found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    members = classes.where("rep is not null").select("rep", "n", F.explode("bands").alias("key"))
    company = stage(members.groupBy("key").count().where("count > 1").select("key"), "company")
    bits = marks.bits_for(company.count())
    members = stage(marks.marked(members, F.col("key"), stage(marks.bitmap(company, F.col("key"), bits), "shared"), bits), "members")
    buckets = stage(members.groupBy(F.col("key").alias("in_key")).agg(F.min("rep").alias("centre"), F.min_by("n", "rep").alias("centre_n"), F.count("*").alias("many")).where("many > 1"), "buckets")
    rows_in = stage(with_groups(members, buckets, "key", "in_key", "many", members.count()).select("key", "rep", "n", "centre", "centre_n", "many"), "in-buckets")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = stage(rows_in.where((F.col("rep") != F.col("centre")) & alike("n", "centre_n")).select(F.col("centre").alias("a"), F.col("rep").alias("b"), F.col("n").alias("nb")).distinct(), "stars")
    links = stage(confirmed(t, stars, size, percent).union(same_ids(found, classes)), "links")
    first = stage(connected_components(links), "first")
    label = first.select(F.col("node").alias("of"), "component")
    open_ = stage(rows_in.where("many > 2").join(label, F.col("rep") == F.col("of"), "left").select("key", "rep", "n", "many", "centre", F.coalesce("component", "rep").alias("c")), "open")
    mixed = stage(open_.groupBy(F.col("key").alias("in_key")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n_in")).where("lo < hi").select("in_key", "n_in"), "mixed")
    rest = stage(with_groups(open_.where("rep != centre"), mixed, "key", "in_key", "n_in", open_.count()).select("key", "rep", "n", "c", "many"), "rest")
    missed = possible(rest, found.select("doc_id", "profile"), percent)
    more = stage(confirmed(t, stage(missed, "missed"), size, percent), "more-links")
    if not more.isEmpty():
        label = connected_components(links.union(more)).select(F.col("node").alias("of"), "component")
    of_class = stage(classes.select(F.col("digest").alias("set"), "rep", "copies").join(label, F.col("rep") == F.col("of"), "left").select("set", "copies", F.coalesce("component", "rep").alias("component")), "of-class")
    found = found.select("doc_id", "n_shingles", "digest")
    out = with_groups(found, of_class, "digest", "set", "copies", found.count()).select("doc_id", "n_shingles", "component").unionByName(found.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def same_ids(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the classes in which one id stands."""
    h = F.xxhash64("digest")
    several = found.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select(F.col("doc_id").alias("of"))
    sets = found.join(several, F.col("doc_id") == F.col("of"), "left_semi").select("doc_id", F.col("digest").alias("set")).distinct()
    reps = stage(sets.join(classes.select("digest", "rep"), F.col("set") == F.col("digest")).select("doc_id", "rep"), "same-ids")
    least = reps.groupBy(F.col("doc_id").alias("of")).agg(F.min("rep").alias("a"))
    return reps.join(least, F.col("doc_id") == F.col("of")).where("a != rep").select("a", F.col("rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **how) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    A row without an id takes part under a number from its text's hash, above all ids; so it goes where a near copy of it stays, and of
    rows without an id that have one text one stays."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = F.coalesce("row.text", F.lit(""))
    nameless = docs.where("doc_id is null").select(row).groupBy(F.sha2(text, 256)).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    docs = docs.where("doc_id is not null").unionByName(nameless)
    stand_in = F.shiftleft(F.lit(1).cast("long"), 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    key = F.coalesce(F.col("doc_id").cast("long"), stand_in)
    name = fresh(docs, "gone")
    gone = near_duplicates(docs.select(key.alias("doc_id"), "text"), size, percent, **how).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, key == gone[name], "left_anti")
