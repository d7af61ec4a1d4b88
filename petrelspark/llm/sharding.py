"""Minimax contiguous sharding, with DataFrame functions only.

Atomic groups (equal texts) stand in the order of a 64-bit hash of the text.  The smallest capacity for which a greedy
left-to-right check needs no more than the given number of shards is found by binary search, and the order is cut
there.  The search runs on the driver over a summary of bounded size: the order is divided into blocks by the leading
bits of the hash, and only blocks in which a probed capacity would cut are fetched in finer bits, down to single groups.
So the result is exact, the driver never holds more than ``most_blocks`` sums at a time beyond those it has asked for,
and each refinement is one aggregation with partial sums.

Of the cuts that keep to the smallest capacity, those are taken that leave each shard nearest to an even share.

Defined results: a null text has the size of an empty one; all empty texts are one group.  A group is never split, so one
that is larger than an even share sets the capacity.  Texts whose 64-bit hashes collide count as one group, which keeps
equal texts together.  An empty table gives an empty result; with fewer groups than shards some shards are empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.columns import texts
from petrelspark.staging import stage


class Blocks:
    """The sizes of blocks of consecutive groups, refined where a cut is asked for.

    A block is (level, number): the groups whose hash, shifted right by ``64 - bits[level]``, is the number.  One with a
    single group is atomic: no cut can fall inside."""

    def __init__(self, rows: list, bits: int):
        self.known = {(int(r["block"]) << (64 - bits), bits): (int(r["bytes"]), int(r["groups"])) for r in rows}
        self.order()

    def order(self) -> None:
        self.keys = sorted(self.known)
        self.ends = list(accumulate(self.known[k][0] for k in self.keys))
        self.starts = [0, *self.ends[:-1]] if self.ends else []
        self.total = self.ends[-1] if self.ends else 0
        self.wanted: set = set()

    def refine(self, block: tuple[int, int], rows: list, bits: int) -> None:
        del self.known[block]
        for r in rows:
            self.known[(int(r["block"]) << (64 - bits), bits)] = (int(r["bytes"]), int(r["groups"]))

    def _inside(self, x: int) -> int | None:
        """The block that ``x`` falls inside, if it is one whose own boundaries aren't known."""
        k = bisect_left(self.ends, x)
        if k < len(self.ends) and self.starts[k] < x < self.ends[k]:
            if self.known[self.keys[k]][1] > 1:
                self.wanted.add(self.keys[k])
            return k
        return None

    def floor(self, x: int) -> int:
        """The last known boundary at or before ``x``."""
        if x >= self.total:
            return self.total
        k = self._inside(x)
        return x if k is None and x <= 0 else self.starts[k] if k is not None else x

    def ceil(self, x: int) -> int:
        """The first known boundary at or after ``x``."""
        if x >= self.total:
            return self.total
        k = self._inside(x)
        return max(x, 0) if k is None else self.ends[k]

    def feasible(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            to = self.floor(at + capacity)
            if to <= at < self.total:
                return False
            at = to
        return at >= self.total

    def cut(self, shards: int, largest: int) -> tuple[int, list[int]]:
        """The smallest feasible capacity and the ends of the shards, as far as the known boundaries tell."""
        low, high = max(-(-self.total // shards), largest) - 1, max(-(-self.total // shards), largest) + largest
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid, high)
        earliest, at = [], self.total  # from where the shards that follow can still hold the rest
        for _ in range(shards):
            earliest.append(at)
            at = self.ceil(max(at - high, 0))
        earliest.reverse()
        ends, at = [], 0
        for k in range(shards):
            even = self.ceil(at + -(-(self.total - at) // (shards - k)))
            at = max(at, earliest[k], min(self.floor(at + high), even))
            ends.append(at)
        return high, ends

    def first_key_after(self, position: int) -> int | None:
        """The smallest hash prefix, as a full hash, of the groups that begin at ``position`` or later."""
        k = bisect_right(self.starts, position - 1)
        while k < len(self.keys) and self.starts[k] < position:
            k += 1
        return self.keys[k][0] if k < len(self.keys) else None


def _blocks(groups: DataFrame, bits: int) -> DataFrame:
    return groups.groupBy(F.shiftright("h", 64 - bits).alias("block")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))


def cut_points(groups: DataFrame, shards: int, most_blocks: int = 256, first_bits: int = 16, more_bits: int = 10) -> tuple[int, list[int | None]]:
    """The smallest capacity, and for each shard but the first the hash of its first group (None: the shard is empty).

    ``groups`` has (h, bytes), a row for each group."""
    largest = groups.agg(F.max("bytes")).first()[0] or 0
    blocks = Blocks(_blocks(groups, first_bits).collect(), first_bits)  # 2**first_bits rows at most
    while True:
        capacity, ends = blocks.cut(shards, largest)
        if not blocks.wanted:
            return capacity, [blocks.first_key_after(e) for e in ends[:-1]]
        by_bits: dict[int, list] = {}
        for block in sorted(blocks.wanted)[:most_blocks]:  # those left over are asked for again in the next round
            by_bits.setdefault(block[1], []).append(block)
        for bits, some in by_bits.items():
            finer = min(64, bits + more_bits)
            inside = groups.where(F.shiftright("h", 64 - bits).isin([k >> (64 - bits) for k, _ in some]))
            found: dict[int, list] = {}
            for r in _blocks(inside, finer).collect():  # most_blocks * 2**more_bits rows at most
                found.setdefault(int(r["block"]) >> (finer - bits), []).append(r)
            for block in some:
                blocks.refine(block, found[block[0] >> (64 - bits)], finer)
        blocks.order()


def shard_of(h: Column, firsts: list[int | None]) -> Column:
    """The shard of a hash: how many shards after the first begin at or before it."""
    begun = [F.when(h >= F.lit(x), 1).otherwise(0) for x in firsts if x is not None]
    return sum(begun[1:], begun[0]) if begun else F.lit(0)


def minimax_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, rows_per_run: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (its place in the shard, gapless from 0).

    Slots come from runs: rows are dealt to runs within their shard by a hash of their number, so that a shard or a hot
    group never has to be one task; a run's first slot is the number of rows in the runs before it."""
    t = texts(docs, id_col=id_col, text_col=text_col)
    size = F.octet_length("text").cast("long") + overhead
    rows = stage(t.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("number")), "shard-rows")
    groups = stage(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    capacity, firsts = cut_points(groups, shards)
    runs = max(8, -(-rows.count() // rows_per_run))
    dealt = rows.withColumn("shard", shard_of(F.col("h"), firsts).cast("int")).withColumn("run", F.pmod(F.xxhash64("number"), F.lit(runs)))
    counts = dealt.groupBy("shard", "run").count()
    before = counts.selectExpr("shard as in_shard", "run as in_run", "sum(count) over (partition by shard order by run) - count as before")
    numbered = dealt.selectExpr("*", "row_number() over (partition by shard, run order by doc_id, number) - 1 as place")
    joined = numbered.join(before, (F.col("shard") == F.col("in_shard")) & (F.col("run") == F.col("in_run")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(capacity).cast("long").alias("capacity"))
