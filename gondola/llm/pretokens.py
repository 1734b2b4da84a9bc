"""Splitting texts into pre-tokens with numpy, for two regular expressions.

``gpt``   's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
``clip``  's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+   (white space is dropped)

Every code point has one of four classes, and where a pre-token starts follows
from the classes of neighbours, so that no Python code runs per pre-token.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex

from gondola.llm.words import runs_hash

WHITE, LETTER, NUMBER, OTHER = range(4)
#: Second and third letter of the contractions that both patterns split off.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[low + m.start() : low + m.end()] = kind
    return table


class Split:
    """The pre-tokens of a list of texts: starts and ends in code points, hashes, bounds per text."""

    def __init__(self, texts: list[str], mode: str):
        self.text = "".join(texts)
        cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        total = len(cp)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        cls = classes()[cp]
        first = np.zeros(total + 1, bool)
        first[edges] = True
        gap = first[:total]
        change = np.ones(total, bool)
        change[1:] = cls[1:] != cls[:-1]
        change |= gap
        white = cls == WHITE
        if mode == "gpt":
            after_space = np.zeros(total, bool)
            after_space[1:] = (cp[:-1] == 0x20) & ~gap[1:]
            # the last of a run of white space stands alone or joins what follows
            last = np.zeros(total, bool)
            last[:-1] = white[:-1] & ~white[1:] & ~gap[1:]
            start = np.where(white, change | last, change & ~after_space)
        else:
            start = change | (cls == NUMBER)
        for i in np.flatnonzero(start & (cp == 0x27)):
            end = edges[np.searchsorted(edges, i, "right")]
            two, one = self.text[i + 1 : min(i + 3, end)], self.text[i + 1 : min(i + 2, end)]
            n = 2 if one and one in SHORT else 3 if two in LONG else 0
            if n:
                start[i + 1 : i + n] = False
                if i + n < total:
                    start[i + n] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.concatenate([self.starts[1:], [total]]) if len(self.starts) else self.starts
        self.cp, self.runs, self.held = cp, self.starts, np.ones(len(self.starts), bool)
        if mode == "clip":
            self.held = ~white[self.starts]
            self.starts, self.ends = self.starts[self.held], self.ends[self.held]
        self.hashes = runs_hash(cp, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, edges)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes that occur, a pre-token that has each, for each pre-token the number of its hash)."""
        which, keys = pd.factorize(self.hashes)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        return keys, first, which

    def confirmed(self, first: np.ndarray, which: np.ndarray) -> bool:
        """Are all pre-tokens equal, code point by code point, to those that stand for their hashes?"""
        lens = self.ends - self.starts
        if (lens != lens[first][which]).any():
            return False
        away = np.zeros(len(self.runs), np.int64)
        away[self.held] = self.starts[first][which] - self.starts
        at = np.repeat(away, np.diff(np.append(self.runs, len(self.cp))))
        at += np.arange(len(self.cp))
        return bool((self.cp[at] == self.cp).all())

    def piece(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def ragged(begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that read the slices of these begins and lengths one after the other, and the slices' ends."""
    ends = np.cumsum(lens)
    at = np.repeat(begin - (ends - lens), lens)
    at += np.arange(len(at))
    return at, ends


def picked(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the slices offsets[r]:offsets[r+1] of all rows."""
    return ragged(offsets[rows], (offsets[1:] - offsets[:-1])[rows])


class Slots:
    """Row numbers by 64-bit key: open addressing, probed for whole arrays of keys at a time."""

    def __init__(self, most: int):
        self.bits = max(int(2 * most).bit_length(), 4)
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._start(keys)
        while len(left):
            rows = self.rows[at]
            same = (self.keys[at] == keys[left]) & (rows >= 0)
            out[left[same]] = rows[same]
            on = (rows >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.rows) - 1)
        return out

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are unknown so far."""
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]], self.keys[at[free]] = rows[left[free]], keys[left[free]]
            lost = self.rows[at] != rows[left]  # held before, or by another key of this round
            left, at = left[lost], (at[lost] + 1) & (len(self.rows) - 1)


class Lists:
    """Number lists one after the other, in an array that doubles."""

    def __init__(self):
        self.n, self.flat, self.offsets = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def add(self, lens: np.ndarray, flat: np.ndarray) -> None:
        at, n = int(self.offsets[self.n]), self.n + len(lens)
        while len(self.flat) < at + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.offsets) < n + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[at : at + len(flat)] = flat
        self.offsets[self.n + 1 : n + 1] = at + np.cumsum(lens)
        self.n = n


class Memo:
    """Id lists by pre-token hash, up to `most` pre-tokens; then it starts anew."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slots, self.ids, self.words = Slots(self.most), Lists(), Lists()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each of the distinct keys, -1 where it is unknown; makes room for the unknown ones."""
        rows = self.slots.find(keys)
        if self.ids.n + int((rows < 0).sum()) > self.most:
            self.clear()
            if len(keys) > self.most:  # one very long text: room for all that it has
                self.slots = Slots(len(keys))
            rows[:] = -1
        return rows

    def put(self, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Rows of new distinct keys with their lists."""
        rows = np.arange(self.ids.n, self.ids.n + len(keys))
        self.slots.put(keys, rows)
        self.ids.add(lens, ids)
        return rows
