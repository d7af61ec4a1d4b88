"""Token-id files under Re-Pair grammar compression, with random access.

Documents go in ascending id order into shards of about ``shard_tokens`` ids.  In each shard the most frequent pairs of
neighbouring ids are replaced by new symbols (nonterminals), again and again; a pair never spans two documents.  A round
takes all of its frequent pairs at once, the more frequent ones first where two overlap, instead of one pair at a time.

Texts become ids where they are read; only ids then move into the order of documents.

File format: Parquet, one row for each shard: part and place (their order), before (the ids of the part's shards before it),
tokens, doc_ids, blob.  The blob, little-endian:

    magic "RPG1"; five u32: first nonterminal, rules, documents, symbols, bytes of a symbol (2 or 4)
    rules: left u32 each; right u32 each; expansion length u32 each
    documents: end of each in the symbols, u32
    symbols, u16 or u32

Rule k makes symbol ``first nonterminal + k`` from two symbols that are smaller.  Expansion lengths let a reader skip to any
id of a document without expanding what comes before.  Spark's committer writes the files, so a lost executor leaves no
half-written shard behind.

Defined results: a null or empty text has the end id alone.  A null doc_id comes first; rows that repeat an id stand in
the order of their ids' hashes.  An empty table makes no shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrelspark.llm.columns import small_batches, texts
from petrelspark.llm.tokens import encoder
from petrelspark.staging import session_dir, stage

_HEAD = struct.Struct("<4s5I")
_MIX, _MIX32 = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


def _frequent(keys: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur ``least`` times or more, ``most`` of them at most: sorted, and the rank by frequency of each."""
    run = np.sort(keys)
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(run)), bool), run[1:] != run[:-1]]))
    counts = np.diff(heads, append=len(run))
    full = np.flatnonzero(counts >= least)
    order = np.argsort(-counts[full], kind="stable")[:most]
    ranks = np.arange(len(order))
    chosen = run[heads[full[order]]]
    by_key = np.argsort(chosen)
    return chosen[by_key], ranks[by_key]


def compress(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int | None = None, least: int = 2, most: int = 2048, width: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document ends, rules) for the ids of documents that end at ``ends``.  ``width``: bits of a symbol.

    Rounds, of ``most`` new rules each at most, go on until no pair occurs ``least`` times or the symbols are used up (or for ``rounds`` of them)."""
    key_type = np.uint32 if width == 16 else np.uint64
    seq, ends, rules, shift = ids.astype(key_type), ends.astype(np.int64), [], key_type(width)
    for _ in count() if rounds is None else range(rounds):
        room = min(most, (1 << width) - first - len(rules))
        if len(seq) < 2 or room <= 0:
            break
        inside = np.ones(len(seq) - 1, bool)
        inside[ends[(ends > 0) & (ends < len(seq))] - 1] = False
        keys = (seq[:-1] << shift) | seq[1:]
        chosen, ranks = _frequent(keys[inside], least, room)
        if not len(chosen):
            break
        slot = (lambda k: (k * _MIX32) >> np.uint32(12)) if width == 16 else lambda k: (k * _MIX) >> np.uint64(44)
        maybe = np.zeros(1 << 20, bool)
        maybe[slot(chosen)] = True
        at = np.flatnonzero(inside & maybe[slot(keys)])
        found = np.minimum(np.searchsorted(chosen, keys[at]), len(chosen) - 1)
        hit = chosen[found] == keys[at]
        at, rank = at[hit], ranks[found[hit]]
        taken = _apart(at, rank)
        used, rank = np.unique(rank[taken], return_inverse=True)
        at = at[taken]
        pair = np.zeros(len(chosen), key_type)
        pair[ranks] = chosen
        rules += [(int(p >> shift), int(p & key_type((1 << width) - 1))) for p in pair[used]]
        seq[at] = (first + len(rules) - len(used) + rank).astype(key_type)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        ends = np.cumsum(keep)[ends - 1] if len(ends) else ends
        seq = seq[keep]
    return seq, ends, np.array(rules, np.uint32).reshape(-1, 2)


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places hold pairs that don't overlap: the lower rank first, of equals in a run every second one."""
    taken = np.zeros(len(at), bool)
    open_ = np.arange(len(at))
    covered = np.zeros(int(at[-1]) + 3 if len(at) else 0, bool)  # by one, so that the place before the first has room
    for _ in range(3):  # what still overlaps then waits for the next round
        a, r = at[open_], rank[open_]
        touches = a[1:] == a[:-1] + 1
        beaten = np.zeros(len(a), bool)
        beaten[1:] |= touches & (r[:-1] < r[1:])
        beaten[:-1] |= touches & (r[1:] < r[:-1])
        same = np.zeros(len(a), bool)
        same[1:] = touches & (r[1:] == r[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        wins = ~beaten & ((np.arange(len(a)) - head) % 2 == 0)
        wins[1:] &= ~(wins[:-1] & touches)  # after a run of equals whose last one was beaten or taken
        now = open_[wins]
        taken[now] = True
        places = at[now] + 1
        covered[places - 1] = covered[places] = covered[places + 1] = True
        open_ = open_[~covered[at[open_] + 1]]
        if not len(open_):
            break
    return taken


def pack(ids: np.ndarray, sizes: np.ndarray, first: int, **how) -> bytes:
    """The blob of a shard of documents with so many ids each."""
    width = 16 if first < 1 << 16 else 32
    symbols, ends, rules = compress(ids, np.cumsum(sizes), first, width=width, **how)
    lengths = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[first + k] = lengths[a] + lengths[b]
    kind = np.dtype("<u2" if width == 16 else "<u4")
    u4 = lambda x: np.asarray(x).astype("<u4").tobytes()
    return _HEAD.pack(b"RPG1", first, len(rules), len(sizes), len(symbols), kind.itemsize) + u4(rules[:, 0]) + u4(rules[:, 1]) + u4(lengths[first:]) + u4(ends) + symbols.astype(kind).tobytes()


#: Ids of a nonterminal that a reader keeps expanded.
SHORT = 64


class Shard:
    """A reader of a blob."""

    def __init__(self, blob: bytes):
        magic, self.first, n_rules, self.documents, n_symbols, width = _HEAD.unpack_from(blob)
        if magic != b"RPG1":
            raise ValueError("not a Re-Pair shard")
        at = _HEAD.size
        u4 = lambda n, at: np.frombuffer(blob, "<u4", n, at)
        self.left, self.right, self.grown = (u4(n_rules, at + 4 * n_rules * k) for k in range(3))
        self.ends = u4(self.documents, at + 12 * n_rules).astype(np.int64)
        self.symbols = np.frombuffer(blob, "<u2" if width == 2 else "<u4", n_symbols, at + 12 * n_rules + 4 * self.documents)
        self.lengths = np.concatenate([np.ones(self.first, np.int64), self.grown.astype(np.int64)])

    def _opened(self, out: np.ndarray, which) -> np.ndarray:
        """Replace the symbols that ``which`` tells by the two that they stand for, until there is none."""
        while len(at := np.flatnonzero(which(out))):
            rule = out[at] - self.first
            wider = np.ones(len(out), np.int64)
            wider[at] = 2
            place = np.cumsum(wider) - wider
            grown = np.repeat(out, wider)
            grown[place[at]], grown[place[at] + 1] = self.left[rule], self.right[rule]
            out = grown
        return out

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all nonterminals of ``SHORT`` ids at most in a row, and where each one's begin."""
        short = np.flatnonzero(self.grown <= SHORT)
        starts = np.zeros(len(self.lengths), np.int64)
        starts[self.first + short] = np.cumsum(self.grown[short].astype(np.int64)) - self.grown[short]
        return self._opened((self.first + short).astype(np.uint32), lambda x: x >= self.first), starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: long ones are opened step by step, short ones looked up."""
        out = self._opened(symbols.astype(np.uint32), lambda x: self.lengths[x] > SHORT)
        ids, starts = self._table
        lengths = self.lengths[out]
        tops = np.cumsum(lengths)
        whole = np.repeat(out, lengths)
        inner = np.flatnonzero(whole >= self.first)
        at = np.repeat(starts[out] - (tops - lengths), lengths)[inner] + inner
        whole[inner] = ids[at]
        return whole

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of document ``k``, or those from ``start`` to ``stop``: only symbols that reach into the range are expanded."""
        own = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        tops = np.cumsum(self.lengths[own])
        stop = int(tops[-1]) if len(tops) and stop is None else stop or 0
        a, b = int(np.searchsorted(tops, start, "right")), int(np.searchsorted(tops, stop, "left")) + 1
        before = int(tops[a - 1]) if a else 0
        return self.expand(own[a:b])[start - before : stop - before]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the number of each one's."""
        sums = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        return self.expand(self.symbols), np.diff(sums[self.ends], prepend=0)


SHARDS = "part int, place long, before long, tokens long, doc_ids array<long>, blob binary"
#: Ranges of documents that files are written by, at most; a reader broadcasts a row for each.
MOST_RANGES = 100_000


def encoded(docs: DataFrame, tokenizer: str, end_id: int, first: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each text and the end id, in two or four bytes each."""
    kind = np.dtype("<u2" if first <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in small_batches(batches, "text"):
            ids, sizes = code.encode(batch.column("text"), end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), blobs], ["doc_id", "n", "ids"])

    return docs.mapInArrow(run, "doc_id long, n long, ids binary")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, first: int = 49408, shard_tokens: int = 1 << 20, range_tokens: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Re-Pair shards to ``path``; ``tokenizer`` is the path of the tokenizer's file, ``first`` the size of its vocabulary.

    ``range_tokens``: ids of a range of documents, which one task writes, at least."""
    kind = np.dtype("<u2" if first <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before, have = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int | None] = []
        kept: list[bytes] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal place, before, have
            ids = np.frombuffer(b"".join(kept), kind).astype(np.uint32)
            out = [pa.array([part], pa.int32()), pa.array([place]), pa.array([before]), pa.array([len(ids)]), pa.array([names], pa.list_(pa.int64())), pa.array([pack(ids, np.array(sizes, np.int64), first)])]
            place, before, have = place + 1, before + len(ids), 0
            for x in (names, kept, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "place", "before", "tokens", "doc_ids", "blob"])

        for batch in batches:
            for name, n, ids in zip(*(batch.column(c) for c in ("doc_id", "n", "ids")), strict=True):
                n = n.as_py()
                if have and have + n > shard_tokens:
                    yield flush()
                names.append(name.as_py())
                sizes.append(n)
                kept.append(ids.as_py())
                have += n
        if kept:
            yield flush()

    tokens = stage(encoded(texts(docs, id_col=id_col, text_col=text_col), tokenizer, end_id, first), "ids")
    ranges = min(MOST_RANGES, max(1, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // range_tokens)))
    ordered = tokens.repartitionByRange(ranges, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"))
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(path: str, spark) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, ids (binary, little-endian u32)."""
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("own")).selectExpr("part as of", "sum(own) over (order by part) - own as earlier")
    placed = files.join(F.broadcast(parts), F.col("part") == F.col("of")).select("doc_ids", "blob", (F.col("before") + F.col("earlier")).alias("start"))  # MOST_RANGES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, blob, start in zip(*(batch.column(c) for c in ("doc_ids", "blob", "start")), strict=True):
                ids, sizes = Shard(blob.as_py()).all()
                tops = np.cumsum(sizes)
                offsets = np.concatenate([[0], tops]) * 4
                cut = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names.as_py(), pa.int64()), pa.array(start.as_py() + tops - sizes), cut], ["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write ``docs`` to the session's part of the shared folder and read the files back: doc_id, start, ids."""
    path = f"{session_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, **how)
    return read_shards(path, docs.sparkSession)
