"""Token ids of whole texts by a public word tokenizer, which is asked for each word once.

The tokenizer drops white space, and no token spans it or the border between a letter and an ASCII digit or mark (an
apostrophe apart), so a text's ids are those of its words and marks in order.  Words recur; each Python worker keeps the
ids of those it has met, under their bytes, up to a fixed size.  Texts that hold the opening of a special token's
name go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from petrelspark.llm import words

_ASCII = np.arange(256) < 128
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARK = _ASCII & ~_LETTER & ~words.IS_SPACE & (np.arange(256) != 39)


def _borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z and the two-byte Latin letters in lower case, and the places between a letter and an ASCII mark or digit."""
    low = words.LOWER[data]
    second = np.zeros(len(data), bool)  # of the letters U+00C0 to U+00FF
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    low[second & (data < 0x9F)] += 32
    letter = _LETTER[data] | second
    letter[:-1] |= second[1:]
    mark = _MARK[data]
    at = np.zeros(len(data), bool)
    at[1:] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    return low, at


class WordEncoder:
    """``path`` names the tokenizer's file, which each executor reads where it is installed."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known = words.Remembered()

    def _ask(self, found: list[bytes]) -> list[list[int]]:
        """The library's ids of each of the words.  Plain words go in one text, in which a closing token ends each."""
        new = [w.decode() for w in found]
        plain = [k for k, w in enumerate(new) if w.isalpha()]
        out: list = [None] * len(new)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self.tokenizer.encode_batch_fast([" ".join(new[k] for k in some)], add_special_tokens=False)[0].ids
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                for k, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[k] = ids[a:b]
        if rest := [k for k, ids in enumerate(out) if ids is None]:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's ids.  ``end`` is appended to each text's ids; a null text is empty."""
        n = len(column)
        ids, sizes = [], np.zeros(n, np.int64)
        special = {k: t for k, t in enumerate(column.cast(pa.large_binary()).to_pylist()) if t and b"<|" in t}
        for texts, data, text_ends in words.pieces(column):
            low, at = _borders(data)
            starts, ends, counts = words.split(data, text_ends, at)
            flat, tops = self.known.ids(*words.distinct(low, starts, ends), self._ask)
            cuts = np.concatenate([[0], tops])[np.cumsum(counts)]
            for k, a, b in zip(texts, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                if k in special:
                    if special[k] is None:  # a later chunk of the text
                        continue
                    own = np.array(self.tokenizer.encode(special[k].decode(), add_special_tokens=False).ids, np.uint32)
                    special[k] = None
                else:
                    own = flat[a:b]
                ids.append((k, own))
                sizes[k] += len(own)
        if end is not None:
            stop, parts = np.array([end], np.uint32), []
            for j, (k, own) in enumerate(ids):
                parts += [own, stop] if j + 1 == len(ids) or ids[j + 1][0] != k else [own]
            sizes += 1
        else:
            parts = [own for _, own in ids]
        return np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.zeros(0, np.uint32), sizes


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The Python worker's encoder; it stays for the tasks that follow."""
    return WordEncoder(path)
