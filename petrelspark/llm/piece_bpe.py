"""Exact encoding by a SentencePiece BPE model, by backtracking instead of merging, and decoding.

Merge-type BPE gives a text the one sequence of pieces in which every two neighbours are compatible: joining their texts and
merging anew gives the same two pieces.  The search goes from left to right, takes the longest piece that an Aho-Corasick
automaton finds at the place and is compatible with the piece before it, else a shorter one, else steps back; a bitfield
holds the places from which no way led on, so that none is tried twice.

Of pairs with equal scores the leftmost merges first, in a text as in the check of two neighbours.

A text is first cut where no piece of the model has the two characters side by side, at white space above all; what lies
between recurs, and each Python worker keeps its ids under its bytes, up to a fixed size.

Defined results: a null or empty text has the begin and end ids alone and decodes to an empty text.  Texts of any length are
encoded whole, in chunks that end where the model joins nothing (one without such a place is one chunk).  Rows that repeat an
id or a text have a result each.  An empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from petrelspark.llm import words

SPACE = "▁"


class Backtracker:
    """The pieces of a text.  ``scores``: normal pieces, the higher one merges first."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.scores = scores
        self.automaton = ahocorasick.Automaton()
        for p in scores:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging gives: again and again the pair whose joined piece has the highest score, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """If ``b`` can follow ``a`` (the empty text: nothing)."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 60_000:
                self.known.clear()
            found = self.known[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def pieces(self, text: str) -> list[str]:
        n = len(text)
        longest = array("H", [1]) * n
        for end, length in self.automaton.iter(text):
            longest[end - length + 1] = max(longest[end - length + 1], length)
        out: list[str] = []
        failed = bytearray(n // 8 + 1)  # bit k: no way leads on from place k
        at, last, length = 0, "", longest[0] if n else 0
        while at < n:
            while length:
                piece, to = text[at : at + length], at + length
                if not failed[to >> 3] >> (to & 7) & 1 and (length == 1 or piece in self.scores) and self.compatible(last, piece):
                    break
                length -= 1
            if length:
                out.append(piece)
                at, last = to, piece
                length = longest[at] if at < n else 0
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                gone = out.pop()
                at, last, length = at - len(gone), out[-1] if out else "", len(gone) - 1
            else:
                raise ValueError("no sequence of compatible pieces: the model's pieces can't all be made by merging")
        return out


class PieceEncoder:
    """``path`` names the model's file, which each executor reads where it is installed."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        names = self.model.id_to_piece(list(range(n)))
        normal = [k for k in range(n) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k))]
        self.ids = {names[k]: k for k in normal}
        self.bytes = {int(names[k][3:5], 16): k for k in range(n) if self.model.is_byte(k)}
        self.search = Backtracker({names[k]: self.model.get_score(k) for k in normal})
        joined = np.zeros((256, 256), bool)  # ASCII neighbours that some piece has; the space for its mark
        for p in self.ids:
            low = [ord(c) if ord(c) < 128 else 32 if c == SPACE else 255 for c in p]
            joined[low[:-1], low[1:]] = True
        joined[128:, :] = joined[:, 128:] = True
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # after the last byte of any other character a space never joins, unless a piece says so
        if not any(b == SPACE and a != SPACE for a, b in pairs):
            joined[128:, 32] = False
        self.joined = joined
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.known = words.Remembered()

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.search.pieces(text):
            if (k := self.ids.get(p)) is not None:
                out.append(k)
            else:
                out += [self.bytes[b] for b in p.encode()]
        return out

    def _ask(self, new: list[bytes]) -> list[list[int]]:
        return [self._ids(w.decode().replace(" ", SPACE)) for w in new]

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a text without begin and end."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes], most: int = words.CHUNK) -> list[np.ndarray]:
        """The ids of texts, of which about ``most`` bytes are handled at a time; the ids do not depend on that."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        whole = pa.array([b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts], pa.large_binary())
        for numbers, data, text_ends in words.pieces(whole, most, self.joined):
            cut = np.ones(len(data), bool)
            cut[1:] = ~self.joined[data[:-1], data[1:]]
            cut[text_ends[text_ends < len(data)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))
            flat, tops = self.known.ids(*words.distinct(data, starts, ends), self._ask)
            borders = np.concatenate([[0], tops])[np.searchsorted(starts, text_ends, "left")].tolist()
            for k, a, b in zip(numbers, [0, *borders[:-1]], borders, strict=True):
                out[k].append(flat[a:b])
        return [np.concatenate([np.zeros(0, np.uint32), *parts]) for parts in out]


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    """The Python worker's encoder; it stays for the tasks that follow."""
    return PieceEncoder(path)
