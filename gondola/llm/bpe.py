"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merges from a heap.

Tier 1.  The vocabulary's tokens are keys of a minimal perfect hash (levels of bit
arrays, gamma 1.5).  All distinct pre-tokens of a pass are probed together; a hit
must have the stored 64-bit hash and, compared in full, the token's bytes.
Tier 2.  A pre-token that is no token becomes a doubly linked list of bytes with a
heap of (rank, position); the lowest rank merges first, the leftmost at a tie.
Its result is remembered in a table of bounded size.

Decoding joins token bytes.  Every encoded text is decoded and compared with its
bytes; should two pre-tokens ever share a 64-bit hash, the text is encoded again
piece by piece.

Defined results: a null text is empty and has no ids.  Special tokens' strings are
ordinary text.  Repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column
from pyspark.sql import functions as F

from gondola.llm.pretokens import Memo, Split, picked, ragged
from gondola.llm.words import mix, runs_hash

#: Pre-tokens that one worker remembers, and code points of one pass.
MEMO, PASS_CHARS = 300_000, 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    assert [r for r, _ in pairs] == list(range(len(pairs))), "ranks have gaps"
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: index() gives each its own number below n.

    A level holds the keys that no other key meets in it; the others go on to the
    next level.  A key's number is the rank of its bit among all levels.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.levels, left, base = [], keys, 0
        while len(left):
            size = max(int(gamma * len(left)), 8)
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.n = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for other values any number, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._place(keys[left], level, size)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


class BytePairs:
    """The two tiers for one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.offsets = np.concatenate([[0], np.cumsum(self.lens)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        words = []
        for i, t in enumerate(tokens):
            try:
                words.append((i, t.decode()))
            except UnicodeDecodeError:
                pass  # never a whole pre-token
        cps = np.frombuffer("".join(w for _, w in words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for _, w in words])
        keys = runs_hash(cps, np.concatenate([[0], ends[:-1]]), ends)
        assert len(np.unique(keys)) == len(keys)
        self.perfect = PerfectHash(keys)
        slot = self.perfect.index(keys)
        self.slot_key, self.slot_id = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64)
        self.slot_key[slot], self.slot_id[slot] = keys, [i for i, _ in words]
        self.memo = Memo(MEMO)

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """Token ids of pre-token hashes; -1 where no token has that hash."""
        at = self.perfect.index(keys)
        hit = (at >= 0) & (self.slot_key[at] == keys)
        return np.where(hit, self.slot_id[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merges, lowest rank first, leftmost at a tie."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            # stale, unless the parts still meet where they did
            if not alive[i] or (j := after[i]) >= n or end[j] != stop or not alive[j]:
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def plain(self, text: str) -> list[int]:
        """The ids of a text, pre-token by pre-token."""
        return [x for p in regex.findall(PATTERN, text) for b in [p.encode()] for x in ([self.ranks[b]] if b in self.ranks else self.merge(b))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = Split(texts, "gpt")
        if not len(split.starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        keys, first, which = split.distinct()
        ids = self.whole(keys)
        hits = np.flatnonzero(ids >= 0)
        wrong = [k for k in hits.tolist() if self.tokens[ids[k]] != split.piece(first[k]).encode()]
        ids[wrong] = -1
        rest = np.flatnonzero(ids < 0)
        row = np.zeros(len(keys), np.int64)
        row[rest] = self.memo.find(keys[rest])
        new = rest[row[rest] < 0]
        if len(new):
            lists = [self.merge(split.piece(k).encode()) for k in first[new].tolist()]
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            row[new] = self.memo.put(keys[new], lens, np.fromiter((x for some in lists for x in some), np.uint32, int(lens.sum())))
        # one table: the memo's lists, then single ids
        hit = np.flatnonzero(ids >= 0)
        held = self.memo.ids
        begin, lens = held.offsets[row], held.offsets[row + 1] - held.offsets[row]
        used = int(held.offsets[held.n])
        begin[hit], lens[hit] = used + np.arange(len(hit)), 1
        flat = np.concatenate([held.flat[:used], ids[hit].astype(np.uint32)])
        at, ends = ragged(begin[which], lens[which])
        out = flat[at]
        cuts = np.concatenate([[0], ends])[split.bounds]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[picked(self.offsets, ids.astype(np.int64))[0]].tobytes()


@cache
def vocabulary(path: str) -> BytePairs:
    """Built once in each worker process."""
    return BytePairs(read_ranks(path))


def text_passes(texts: list[str | None], most: int = PASS_CHARS):
    """The texts (null: empty) in groups of about `most` code points."""
    group, size = [], 0
    for x in texts:
        x = x or ""
        if group and size + len(x) > most:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def encoded(path: str, text: Column, tokens: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, tokens]) of a text column.

    path: the rank file, the same on every executor.  Digests are of the ids as
    little-endian unsigned 32-bit integers and of the decoded bytes.
    """
    fields = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + ", tokens: array<int>" * tokens

    @F.arrow_udf(f"struct<{fields}>")
    def run(column: pa.Array) -> pa.Array:
        pairs = vocabulary(path)
        n, shas, back, lists = [], [], [], []
        for group in text_passes(column.to_pylist()):
            for x, ids in zip(group, pairs.encode(group)):
                raw, decoded = x.encode(), pairs.decode(ids)
                if decoded != raw:
                    ids = np.array(pairs.plain(x), np.uint32)
                    decoded = pairs.decode(ids)
                n.append(len(ids))
                shas.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if tokens:
                    lists.append(ids.astype(np.int32))
        arrays = [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if tokens:
            arrays, names = [*arrays, pa.array(lists, pa.list_(pa.int32()))], [*names, "tokens"]
        return pa.StructArray.from_arrays(arrays, names=names)

    return run(text)
