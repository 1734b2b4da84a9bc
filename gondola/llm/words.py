"""Words, word hashes and shingles of many texts at once, with numpy over their bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Each
word gets a 64-bit polynomial hash, taken from prefix sums over the whole batch,
so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, UNBASE)):
            steps = np.full(max(n, PASS_BYTES + (1 << 16)), base)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices values[starts:ends], equal for equal slices."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def passes(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as bytes (null: empty), in groups of about PASS_BYTES."""
    group, size = [], 0
    for x in texts.cast(pa.large_binary()).to_pylist():
        x = x or b""
        if group and size + len(x) > PASS_BYTES:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x) + 1
    if group:
        yield group


class Words:
    """Of the texts of a pass: bytes, word starts and ends, hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.raw = raw
        self.bytes = LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = ~SPACE[raw]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes + 1)
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)])
        self.hashes = runs_hash(self.bytes, self.starts, self.ends)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within one text, and their bounds."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    rolled = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        rolled = rolled * BASE + hashes[j : total - n + 1 + j]
    rolled = mix(rolled)
    counts = np.diff(bounds)
    last = np.repeat(bounds[1:], counts)[: total - n + 1]
    keep = np.arange(total - n + 1) + n <= last
    return rolled[keep], np.concatenate([[0], np.cumsum(np.maximum(counts - n + 1, 0))])


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles.

    With fewer words the whole sequence is the only shingle; without words the set is empty.
    """
    for group in passes(texts):
        words = Words(group)
        grams, bounds = ngrams(words.hashes, words.bounds, n)
        for k in range(len(group)):
            if bounds[k + 1] > bounds[k]:
                yield np.unique(grams[bounds[k] : bounds[k + 1]])
            else:
                own = words.hashes[words.bounds[k] : words.bounds[k + 1]]
                if not len(own):
                    yield own
                    continue
                whole = np.uint64(0)
                with np.errstate(over="ignore"):
                    for h in own:
                        whole = whole * BASE + h
                    yield mix(np.array([whole + np.uint64(len(own)) * MIX2]))
