"""Alignment of two tokenizers: which ids of a byte-level BPE go with which ids of a piece model.

Both encode space + text.  Byte offsets where a token of each ends cut the tokens into
groups; all pairs of a group are links.  How many documents hold a pair linked is counted
corpus-wide.

Encoding.  Neither tokenizer joins a non-space character with a space or line end after it (checked
for the vocabulary), so a text is cut there into segments, each a group border of both.  Tokens, groups and links of
a segment are worked out once and remembered in a table of bounded size.

Counting.  A pair is one int64, `a << 32 | b`.  Each partition counts its documents' distinct keys with np.unique
and passes on partial counts; these are range-partitioned and sorted, and runs of one key summed.  Each range becomes
a shard file of sorted keys and their counts, from which the highest count of each A id follows (one number an id).

Lookup.  Shards are memory-mapped (read, where the shared folder is no local file system), and a batch's distinct keys found by searchsorted.

Defined results: texts that are null, empty, or whose joined A or B bytes differ from space + text have no
tokens: numbers are 0, digest and groups are empty texts.  Repeated rows are documents of their own, each
counts.  Other columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm import shared
from gondola.llm.bpe import text_passes
from gondola.llm.files import Appender, opened
from gondola.llm.pretokens import ragged

#: A segment starts at a space or line end after what is no white space (with two characters on whose class libraries differ).
BORDER = re.compile(r"(?<=[^\s\u180e\u200b])(?=[ \n])")
SPACE = "\u2581"


@dataclass(frozen=True)
class AlignParams:
    memo: int = 300_000  #: segments that one worker remembers
    memo_links: int = 4_000_000  #: and their links
    wide: int = 1 << 20  #: links of a group from which its distinct ids are paired instead of its tokens
    partial: int = 2_000_000  #: keys that are counted at a time


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Growing:
    """Numbers one after the other, in an array that doubles."""

    def __init__(self):
        self.n, self.held = 0, np.zeros(1 << 16, np.int64)

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


def linked(ends_a: np.ndarray, ends_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, wide: int):
    """(ends of groups, tokens of A and of B in each, group of each link, pair key, how often) of token ends in bytes."""
    ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n_a, n_b = (np.bincount(np.searchsorted(ends, x), minlength=len(ends)) for x in (ends_a, ends_b))
    start_b = np.cumsum(n_b) - n_b
    group = np.repeat(np.arange(len(ends)), n_a)
    narrow = (n_a * n_b <= wide)[group]
    group, left = group[narrow], ids_a[narrow]
    at, _ = ragged(start_b[group], n_b[group])
    keys = np.repeat(left, n_b[group]) << 32 | ids_b[at]
    of, times = np.repeat(group, n_b[group]), np.ones(len(keys), np.int64)
    start_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(n_a * n_b > wide).tolist():
        (a, ca), (b, cb) = (np.unique(x[s : s + n], return_counts=True) for x, s, n in ((ids_a, start_a[g], n_a[g]), (ids_b, start_b[g], n_b[g])))
        keys = np.concatenate([keys, (a[:, None] << 32 | b).ravel()])
        times, of = np.concatenate([times, (ca[:, None] * cb).ravel()]), np.concatenate([of, np.full(len(a) * len(b), g)])
    return ends, n_a, n_b, of, keys, times


class Aligner:
    """Both tokenizers, and what is known of segments."""

    def __init__(self, byte_level: str, piece_model: str, params: AlignParams):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.params = params
        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=piece_model)
        self.a.encode_special_tokens = True
        stands_for = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(stands_for[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lens_a, self.lens_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(SPACE)
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n")
        #: Does no piece go on over a border?  Else texts are encoded whole.
        self.cuts = pieces[self.space] == SPACE and not any(crossing.search(p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.groups: list[str] = []
        self.sound: list[bool] = []
        self.numbers, self.ends, self.keys, self.times = Growing(), Growing(), Growing(), Growing()
        self.ends.add(np.zeros(1, np.int64))

    def segments(self, text: str) -> list[str]:
        return BORDER.split(" " + text) if self.cuts else [" " + text]

    def piece_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of B.  It puts a space before what it gets: that of the segment, or one too many before a line end."""
        found = self.b.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        return [ids[1:] if x[0] != " " else ids or [self.space] for x, ids in zip(segments, found)]

    def learn(self, segments: list[str]) -> None:
        """Tokens, groups and links of new segments."""
        lists_a = [x.ids for x in self.a.encode_batch(segments, add_special_tokens=False)]
        lists_b = self.piece_ids(segments)
        raw = [x.encode() for x in segments]
        joined = lambda pieces, ids: b"".join([pieces[i] for i in ids])
        sound = [joined(self.bytes_a, a) == x == joined(self.bytes_b, b) for a, b, x in zip(lists_a, lists_b, raw)]
        lists_a, lists_b = ([x if ok else [] for x, ok in zip(lists, sound)] for lists in (lists_a, lists_b))
        flat_a, flat_b = (np.fromiter((i for x in lists for i in x), np.int64) for lists in (lists_a, lists_b))
        ends, n_a, n_b, of, keys, times = linked(np.cumsum(self.lens_a[flat_a]), np.cumsum(self.lens_b[flat_b]), flat_a, flat_b, self.params.wide)
        stops = np.cumsum([len(x) if ok else 0 for x, ok in zip(raw, sound)])
        upto = np.searchsorted(ends, stops, "right")  # groups up to the end of each segment
        first = np.concatenate([[0], upto[:-1]])
        link_sum = np.concatenate([[0], np.cumsum(n_a * n_b)])
        self.numbers.add(np.stack([[len(x) for x in lists_a], [len(x) for x in lists_b], upto - first, link_sum[upto] - link_sum[first]], 1).ravel())
        order = np.argsort(of, kind="stable")
        self.ends.add(self.keys.n + np.searchsorted(of[order], upto))
        self.keys.add(keys[order])
        self.times.add(times[order])
        ids_a, ids_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        some = lambda ids, at, n: ids[at] if n == 1 else ",".join(ids[at : at + n])
        places = (x.tolist() for x in (np.cumsum(n_a) - n_a, n_a, np.cumsum(n_b) - n_b, n_b))
        texts = [f"{some(ids_a, i, n)}|{some(ids_b, j, m)}" for i, n, j, m in zip(*places)]
        self.groups += [";".join(texts[a:b]) for a, b in zip(first.tolist(), upto.tolist())]
        self.sound += sound

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links), groups as text, distinct pair keys and how often each is linked, of each text."""
        if len(self.rows) > self.params.memo or self.keys.n > self.params.memo_links:
            self.clear()
        parts = [self.segments(x) if x else [] for x in texts]
        new = dict.fromkeys(x for own in parts for x in own if x not in self.rows)
        if new:
            self.rows.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
            self.learn(list(new))
        numbers, ends, keys, times = self.numbers.values.reshape(-1, 4), self.ends.values, self.keys.values, self.times.values
        none = np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        for own in parts:
            rows = [self.rows[x] for x in own]
            if not rows or not all([self.sound[r] for r in rows]):
                yield none
                continue
            at = np.array(rows)
            where, _ = ragged(ends[at], ends[at + 1] - ends[at])
            yield numbers[at].sum(axis=0), ";".join([self.groups[r] for r in rows]), *summed(keys[where], times[where])


@cache
def aligner(byte_level: str, piece_model: str, params: AlignParams) -> Aligner:
    """Built once in each worker process."""
    return Aligner(byte_level, piece_model, params)


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def aligned(docs: DataFrame, byte_level: str, piece_model: str, params: AlignParams = AlignParams(),
            id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(ROWS[, groups]) for each row of docs, stored.

    keys: the document's distinct pairs, sorted, as little-endian int64; times: how often each is linked.  groups: `a1,a2|b1;a3|b2,b3`,
    ids in order; groups_sha256 is its digest.  The paths are the same on every executor.
    """
    shared.bounded_batches(docs.sparkSession)
    schema = ROWS + ", groups string" * groups

    def run(batches):
        both = aligner(byte_level, piece_model, params)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * groups
        for batch in batches:
            ids = iter(batch["doc_id"].to_pylist())
            for group in text_passes(batch["text"].to_pylist()):
                found = []
                for numbers, text, keys, times in both.align(group):
                    sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
                    found.append((next(ids), *numbers.tolist(), sha, keys.astype("<i8").tobytes(), times.astype("<i8").tobytes(), text)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return shared.stored(rows.mapInArrow(run, schema), "aligned", "zstd")


# --- counts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PairCounts:
    """Sorted shards of pair counts: (file, low, high, n), in order of keys, and the file of each A id's highest count."""

    shards: tuple[tuple[str, int, int, int], ...]
    best: str | None


@cache
def mapped(uri: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the file system is local."""
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), np.uint8)


def shard_arrays(uri: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of a shard."""
    data = mapped(uri)
    return data[: 8 * n].view("<i8"), data[8 * n : 16 * n].view("<i8")


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed int64, and how many each row has."""
    lens = np.fromiter((len(x.as_buffer()) // 8 for x in column), np.int64, len(column))
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), "<i8")
    return flat, lens


def pair_counts(rows: DataFrame, folder: str, params: AlignParams = AlignParams()) -> PairCounts:
    """How many of the rows that aligned() gave hold each pair, in files below folder."""

    def partial(batches):
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            return summed(np.concatenate([keys, new]), np.concatenate([counts, n]))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

        for batch in batches:
            waiting.append(_keys(batch["keys"])[0])
            size += len(waiting[-1])
            if size > params.partial:
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) > params.partial:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield out()

    # written first: finding range bounds reads it once more
    parts = shared.stored(rows.select("keys").mapInArrow(partial, "key long, n long"), "pair-partials")

    def write(batches):
        out, found, waiting, size = Appender(folder, ".pairs", 1), [], [], 0

        def close(last: bool):
            keys, n = summed(*(np.concatenate(x) for x in zip(*waiting)))
            stop = len(keys) - (not last)  # the last run may go on
            if stop:
                file, _ = out.add(keys[:stop].astype("<i8").tobytes() + n[:stop].astype("<i8").tobytes())
                found.append((file, int(keys[0]), int(keys[stop - 1]), stop))
            return [(keys[stop:], n[stop:])]

        for batch in batches:
            waiting.append((batch["key"].to_numpy(), batch["n"].to_numpy()))
            size += len(batch)
            if size > params.partial:
                waiting, size = close(False), 0
        if waiting:
            close(True)
        out.close()
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "low", "high", "n"])

    index = shared.stored(parts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, "file string, low long, high long, n long"), "pair-shards")
    # one row a shard of millions of pairs, or a range partition
    shards = tuple((r.file, r.low, r.high, r.n) for r in index.orderBy("low").collect())

    def highest(batches):
        for batch in batches:
            for file, n in zip(batch["file"].to_pylist(), batch["n"].to_pylist()):
                keys, counts = shard_arrays(file, n)
                a = keys >> 32
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(np.maximum.reduceat(counts, starts))], ["a", "n"])

    def write_best(batches):
        # one number an id of the vocabulary: a bound that data cannot exceed
        best = np.zeros(0, np.int64)
        for batch in batches:
            a = batch["a"].to_numpy()
            if len(a):
                best = np.concatenate([best, np.zeros(max(int(a.max()) + 1 - len(best), 0), np.int64)])
                best[a] = batch["n"].to_numpy()
        out = Appender(folder, ".best", 1)
        file, _ = out.add(best.astype("<i8").tobytes())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    if not shards:
        return PairCounts((), None)
    tops = index.select("file", "n").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
    file = shared.stored(tops.coalesce(1).mapInArrow(write_best, "file string"), "pair-best").first()["file"]
    return PairCounts(shards, file)


def looked_up(keys: np.ndarray, counts: PairCounts) -> tuple[np.ndarray, np.ndarray]:
    """(count of each pair, is it the highest of its A id?); 0 for pairs that no document holds."""
    some, which = np.unique(keys, return_inverse=True)
    n = np.zeros(len(some), np.int64)
    for file, low, high, size in counts.shards:
        a, b = np.searchsorted(some, low), np.searchsorted(some, high, "right")
        if a < b:
            held, held_n = shard_arrays(file, size)
            at = np.searchsorted(held, some[a:b])
            n[a:b] = np.where(held[at] == some[a:b], held_n[at], 0)
    best = mapped(counts.best).view("<i8") if counts.best else np.zeros(0, np.int64)
    top = (n > 0) & (n == best[np.minimum(some >> 32, len(best) - 1)]) if len(best) else np.zeros(len(some), bool)
    return n[which], top[which]


def with_counts(rows: DataFrame, counts: PairCounts) -> DataFrame:
    """Columns of rows but keys and times, with n_best (links whose count is their A id's highest) and count_sum (over links)."""
    names = [c for c in rows.columns if c not in ("keys", "times")]

    def run(batches):
        for batch in batches:
            keys, lens = _keys(batch["keys"])
            times, _ = _keys(batch["times"])
            n, top = looked_up(keys, counts)
            ends = np.concatenate([[0], np.cumsum(lens)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times * top, times * n)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in names)
    return rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
