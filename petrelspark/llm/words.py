"""Words of many texts at once, as numpy arrays: where they are, which are equal, and a 64-bit hash of each.

A word is a maximal run of bytes other than space and U+0009 to U+000D.  Which words of a chunk are equal is told by their
bytes.  Hashes (XXH3, of each distinct word once) depend on the word's bytes alone, so they are the same in every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; a longer text is cut at white space.
CHUNK = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words among ``data[start:end]``, compared by bytes, and which of them each one is.

    The words stand in order and leave out nothing but white space, or nothing at all."""
    lengths = ends - starts
    borders = np.concatenate([[0], np.cumsum(lengths)])
    if borders[-1] != len(data):
        data = data[~IS_SPACE[data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    _, ends_buffer, raw = coded.dictionary.buffers()
    raw, at = raw.to_pybytes() if raw else b"", np.frombuffer(ends_buffer, np.int64)[: len(coded.dictionary) + 1].tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])], coded.indices.to_numpy()


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, as for ``distinct``."""
    from xxhash import xxh3_64_intdigest

    words, codes = distinct(data, starts, ends)
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))[codes]


def tidy() -> None:
    """Give memory that a task has freed back to the system, as its Python worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Remembered:
    """Ids of words that recur: those a Python worker has met, up to a fixed number of bytes, in arrays.

    Words are found by their hashes and then compared by their bytes; of two with one hash the second is asked for each time.
    ``most``: bytes of what is kept before it starts anew, so a word of any length stays no longer than until the next chunk."""

    def __init__(self, most: int = 24 << 20):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.letters, self.words = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.places, self.letters, self.words, self.flat, self.ends))

    def _find(self, words: list[bytes], hashed: np.ndarray) -> np.ndarray:
        """Where each word is kept; -1 where it isn't."""
        at = np.minimum(np.searchsorted(self.keys, hashed), max(0, len(self.keys) - 1))
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return found
        hit = np.flatnonzero(self.keys[at] == hashed)
        kept = self.places[at[hit]].astype(np.int64)
        lengths = np.fromiter((len(words[k]) for k in hit), np.int64, len(hit))
        same = self.words[kept + 1] - self.words[kept] == lengths
        hit, kept, lengths = hit[same], kept[same], lengths[same]
        ends = np.cumsum(lengths)
        mine = np.frombuffer(b"".join([words[k] for k in hit]), np.uint8)
        other = self.letters[np.repeat(self.words[kept] - (ends - lengths), lengths) + np.arange(len(mine))]
        apart = np.concatenate([[0], np.cumsum(mine != other)])
        equal = apart[ends] == apart[ends - lengths]
        found[hit[equal]] = kept[equal]
        return found

    def ids(self, words: list[bytes], codes: np.ndarray, ask) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words in a row, where each word's end) for words given as by ``distinct``; ``ask`` gives the ids of new ones."""
        from xxhash import xxh3_64_intdigest

        if self.bytes > self.most:
            self.forget()
        hashed = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        at = self._find(words, hashed)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [words[k] for k in fresh]
            got = ask(new)
            at[fresh] = len(self.ends) - 1 + np.arange(len(fresh))
            total = lambda x: np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))
            self.words, self.ends = np.concatenate([self.words, self.words[-1] + total(new)]), np.concatenate([self.ends, self.ends[-1] + total(got)])
            self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(new), np.uint8)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(self.ends[-1]) - len(self.flat))])
            some, first = np.unique(hashed[fresh], return_index=True)
            where = np.searchsorted(self.keys, some)
            own = np.ones(len(some), bool) if not len(self.keys) else self.keys[np.minimum(where, len(self.keys) - 1)] != some
            self.keys, self.places = np.insert(self.keys, where[own], some[own]), np.insert(self.places, where[own], at[fresh][first[own]].astype(np.int32))
        each = at[codes]
        lengths = self.ends[each + 1] - self.ends[each]
        tops = np.cumsum(lengths)
        return self.flat[np.repeat(self.ends[each] - (tops - lengths), lengths) + np.arange(int(lengths.sum()))], tops


def pieces(column: pa.Array, most: int = CHUNK, joined: np.ndarray | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The texts of an Arrow column in chunks of about ``most`` bytes: (numbers of the texts, bytes, ends of the texts in them).

    A text of more than ``most`` bytes comes in several chunks, cut at white space (or uncut where it has none).  With ``joined``, for which two bytes
    side by side belong together, it is cut only where two don't."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)

    def free(a: int, b: int) -> np.ndarray:  # where a cut may be
        return IS_SPACE[data[a:b]] if joined is None else ~joined[data[a - 1 : b - 1], data[a:b]]

    k = 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        at, end = int(offsets[k]), int(offsets[to])
        if to > k + 1 or end - at <= most:
            yield list(range(k, to)), data[at:end], offsets[k + 1 : to + 1] - at
        else:
            while at < end:
                cut = min(at + most, end)
                while cut < end and not free(cut, cut + 1)[0]:
                    step = np.flatnonzero(free(cut, min(cut + most, end)))
                    cut = min(end, cut + (int(step[0]) if len(step) else most))
                yield [k], data[at:cut], np.array([cut - at])
                at = cut
        k = to


def split(data: np.ndarray, text_ends: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words in each text.  ``also``: further places where a word begins if none of the two sides is a space."""
    full = ~IS_SPACE[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    if also is not None:
        begins |= also & full
    inner = text_ends[text_ends < len(data)]
    begins[inner] |= full[inner]
    last = full.copy()
    last[:-1] &= ~full[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, text_ends, "left"), prepend=0)
