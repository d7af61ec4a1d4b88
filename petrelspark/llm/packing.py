"""Best-fit packing of documents' tokens into sequences, by hierarchical residual packing.

Each task packs the pieces of its own part of the input best-fit, largest first, and emits the bins that are nearly full.
The underfull bins are items of the next round: bins of several tasks meet in groups of bounded size and are packed
best-fit again, until one group has them all.  Where there are more than a group may have, and dealing them at random hardly helps any
more, those meet whose fills complement each other, and at last the emptiest, until no two bins fit into one; how many bins have which fill, at most
one number for each, tells who meets.  Texts never move; a bin carries what its pieces are (ids, places, lengths, checksums), at most one entry for each
of its tokens.

Defined results: a null or empty text is one piece, the end id; which of equally long pieces goes first is left open.  A document that fits is one piece; only longer ones are
cut, into pieces of the capacity, the last one shorter or not.  Rows that repeat an id are packed each.  An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.columns import small_batches, texts
from petrelspark.llm.tokens import encoder
from petrelspark.staging import stage

#: A bin's pieces are parallel lists.
FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
BINS = "group long, fill long, done boolean, sequence_id long, " + ", ".join(f"{k} array<{'int' if v == pa.int32() else 'long'}>" for k, v in FIELDS.items()) + ", offset array<long>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, into the fullest bin that still has room, or else a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # the open bins by what they have left
    open_, bins, out = 0, 0, np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for k, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_ >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            at, left = bins, capacity
            bins += 1
        out[k] = at
        left -= s
        if left:
            if not room[left]:
                open_ |= 1 << left
            room[left].append(at)
    return out


def _bins(items: dict[str, np.ndarray], item_of: np.ndarray, sizes: np.ndarray, capacity: int, full: int, last: bool, group: int, first_id: int) -> pa.RecordBatch:
    """Pack items of the given sizes; ``item_of`` is the item of each piece in ``items``."""
    at = best_fit(sizes, capacity)
    bin_of = at[item_of]
    order = np.argsort(bin_of, kind="stable")
    pieces = {k: v[order] for k, v in items.items()}
    counts = np.bincount(bin_of, minlength=int(at.max()) + 1 if len(at) else 0)
    ends = np.cumsum(counts)
    tops = np.cumsum(pieces["length"])
    fill = np.diff(tops[ends - 1], prepend=0) if len(ends) else ends
    offset = tops - pieces["length"] - np.repeat(np.cumsum(fill) - fill, counts)
    lists = pa.array(np.concatenate([[0], ends]), pa.int32())
    none = lambda v: pa.array(v, mask=v == np.iinfo(np.int64).min) if v.dtype == np.int64 else pa.array(v)
    arrays = [pa.array(np.full(len(counts), group)), pa.array(fill), pa.array(np.full(len(counts), True) if last else fill >= full), pa.array(first_id + np.arange(len(counts)))]
    arrays += [pa.ListArray.from_arrays(lists, none(pieces[k]).cast(v)) for k, v in FIELDS.items()] + [pa.ListArray.from_arrays(lists, pa.array(offset))]
    return pa.RecordBatch.from_arrays(arrays, ["group", "fill", "done", "sequence_id", *FIELDS, "offset"])


def _pieces(batch: pa.RecordBatch, code, end_id: int, capacity: int) -> dict[str, np.ndarray]:
    """The pieces of a batch's documents."""
    ids, sizes = code.encode(batch.column("text"), end_id)
    names = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    counts = -(-sizes // capacity)
    piece = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * capacity
    length = np.minimum(np.repeat(sizes, counts) - start, capacity)
    base = np.repeat(np.cumsum(sizes) - sizes, counts) + start
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(base.tolist(), length.tolist(), strict=True)), np.int64, len(base))
    return {"doc_id": np.repeat(names, counts), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}


def pack_tokens(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, nearly: float = 0.99, per_group: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``nearly``: the fill from which a bin is emitted before the last round.  ``per_group``: items that are packed at once."""
    full = int(capacity * nearly)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, given = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kept: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal given
            items = {k: np.concatenate([x[k] for x in kept]) for k in FIELDS}
            kept.clear()
            n = len(items["length"])
            out = _bins(items, np.arange(n), items["length"], capacity, full, False, part, (part << 32) + given)
            given += out.num_rows
            return out

        for batch in small_batches(batches, "text"):
            if batch.num_rows:
                kept.append(_pieces(batch, code, end_id, capacity))
            if sum(len(x["length"]) for x in kept) >= per_group:
                yield flush()
        if kept:
            yield flush()

    def merge(step: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            group = table.column("to")[0].as_py()
            counts = np.diff(table.column("length").combine_chunks().offsets.to_numpy())
            items = {k: table.column(k).combine_chunks().flatten().fill_null(np.iinfo(np.int64).min if k == "doc_id" else 0).to_numpy(zero_copy_only=False) for k in FIELDS}
            sizes = table.column("fill").to_numpy()
            return pa.Table.from_batches([_bins(items, np.repeat(np.arange(len(counts)), counts), sizes, capacity, full, last, group, (step << 58) + (group << 32))])

        return run

    bins = stage(texts(docs, id_col=id_col, text_col=text_col).mapInArrow(local, BINS), "bins")
    done, left, step, groups, way, before = bins.where("done"), bins.where("not done"), 0, None, "random", None
    while fills := {r["fill"]: r["count"] for r in left.groupBy("fill").count().collect()}:  # at most the capacity's number of rows
        count, step = sum(fills.values()), step + 1
        need = -(-count // per_group)
        slow = before is not None and count > 0.98 * before
        if need == 1:
            groups, way = 1 if groups is None or way != "random" else max(1, groups // 2), "random"
        elif way == "random" and not (slow and groups == need_before):
            groups = need if groups is None else max(need, groups // 2)
        else:
            way = "complement" if way == "random" or way == "complement" and not slow else "emptiest"
            if way == "emptiest" and not two_fit(fills, capacity):
                break
        number = F.xxhash64("sequence_id", F.lit(step))
        if way == "random":
            meet, apart = left.withColumn("to", F.pmod(number, F.lit(groups))), None
        else:
            table = left.sparkSession.createDataFrame((by_complement if way == "complement" else emptiest)(fills, capacity, per_group), "of_fill long, first long, parts long")
            dealt = left.join(F.broadcast(table), F.col("fill") == F.col("of_fill"), "left").drop("of_fill")
            meet = dealt.where("first is not null").withColumn("to", F.col("first") + F.pmod(number, F.col("parts"))).drop("first", "parts")
            apart = dealt.where("first is null").drop("first", "parts")
        bins = meet.groupBy("to").applyInArrow(merge(step, way == "random" and groups == 1), BINS)
        bins = stage(bins if apart is None else bins.unionByName(apart), "bins")
        done, left, before, need_before = done.unionByName(bins.where("done")), bins.where("not done"), count, need
    return done.unionByName(left).select("sequence_id", F.explode(F.arrays_zip(*FIELDS, "offset")).alias("p")).select(*[f"p.{k}" for k in FIELDS], "sequence_id", "p.offset")


def two_fit(fills: dict[int, int], capacity: int) -> bool:
    """If the two emptiest bins fit into one; ``fills`` has the number of bins of each fill."""
    least = sorted(fills)
    a = least[0]
    b = a if fills[a] > 1 else least[1] if len(least) > 1 else capacity + 1
    return a + b <= capacity


def by_complement(fills: dict[int, int], capacity: int, per_group: int) -> list[tuple[int, int, int]]:
    """(fill, first group, groups): fills in groups of about ``per_group`` bins, those together whose sum is near the capacity.  A fill that
    more bins have than a group takes is dealt over several."""
    out, group, room = [], 0, per_group
    for f in sorted(fills, key=lambda f: (-abs(2 * f - capacity), f)):
        parts = -(-fills[f] // per_group)
        if fills[f] > room and room < per_group:
            group, room = group + 1, per_group
        out.append((f, group, parts))
        room -= fills[f]
        if room <= 0:
            group, room = group + parts, per_group
    return out


def emptiest(fills: dict[int, int], capacity: int, per_group: int) -> list[tuple[int, int, int]]:
    """(fill, first group, groups) for the emptiest bins alone, which meet in one group; the last fill that has a place there may go on in more."""
    out, room = [], per_group
    for f in sorted(fills):
        if fills[f] > room:
            return [*out, (f, 0, 1 + -(-fills[f] // per_group))]
        out.append((f, 0, 1))
        room -= fills[f]
    return out
