"""Token ids in grammar-compressed binary files (Re-Pair per shard).

Documents are range-partitioned in ascending id order (nulls last; ties by a hash
of the text), encoded, closed with an end id and collected into shards of about
`shard_ids` ids.  Within a shard, frequent pairs of neighbouring ids are replaced
by nonterminals, in rounds from the most frequent pairs down, until no pair pays for
its rule: a rule takes 12 bytes and each occurrence saves 4, so `least` is 4.  A pair never
crosses the end of a document, so any document expands alone.

A shard, little-endian, in this order:
    magic ``GRP3``; uint32 documents, rules, symbols, first nonterminal, symbols of a
    block, bytes of the packed head; uint32 bytes of each packed block of symbols
    int64   id of each document      uint8  1 where that id is null
    uint32  ids of each document     uint32 symbols of each document
    uint32  left and right symbol of each rule; uint32 expansion length of each rule
    uint32  symbols
All before the symbols is the head, packed (zstd) as one; symbols are packed by blocks,
so that a document is read without unpacking the others'.  A file holds several
shards, and the index says where each one is.  Expansion lengths let a reader skip to the n-th id
of a document without expanding what lies before it.

Defined results: null and empty texts hold the end id alone.  Repeated ids and
rows are documents of their own.  An empty table gives no rows and no file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm import shared
from gondola.llm.bpe import text_passes
from gondola.llm.files import Appender, ranged_reads, read_tasks
from gondola.llm.pretokens import Memo, Split, classes, picked, ragged

MAGIC = b"GRP3"
INDEX = "part int, shard int, docs bigint, tokens bigint, file string, offset bigint, length bigint"
READ = "doc_id bigint, part int, shard int, k int, n_tokens bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class TokenFileParams:
    end_id: int = 1
    shard_ids: int = 1 << 20  #: ids after which a shard ends (with a whole document)
    least: int = 4  #: occurrences that a pair needs; replacement ends when no pair has them
    share: float = 0.02  #: part of the most frequent pair's occurrences that a pair of the same round needs
    file_bytes: int = 64 << 20
    task_bytes: int = 16 << 20  #: file bytes that one reading task takes
    block: int = 1 << 14  #: symbols that are packed together
    memo: int = 600_000  #: pre-tokens that one worker remembers


# --- encoding -------------------------------------------------------------------------------------


class WordEncoder:
    """The tokenizers library, asked once for each distinct word.

    Splits texts as the library's own pre-tokenizer does.  A text with code points
    that normalisation could join or split, or with an added token's content in any
    case, goes to the library whole.  A word is known again by its hash and then
    compared in full; should two words ever share a hash, the library gets the texts.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # the same model for words that are split and in lower case already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(memo)
        table = classes()
        # plain: a code point whose lower case is one code point of the same class, and that never composes
        plain = np.zeros(0x110000, bool)
        for c in range(0x3000):
            x = chr(c)
            low = x.lower()
            plain[c] = len(low) == 1 and table[ord(low)] == table[c] and not unicodedata.combining(x) and unicodedata.is_normalized("NFC", x) and x != "Σ"
        plain[0x1100:0x1200] = False
        self.plain = plain

    def words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-case pre-tokens: how many ids each has, and all ids."""
        lens, flat = [], []
        for k in range(0, len(pieces), 256):
            part = pieces[k : k + 256]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):  # not split as expected: each alone
                each = [x.ids for x in self.library.encode_batch(part, add_special_tokens=False)]
                ends, ids = np.cumsum([len(x) for x in each]), np.array([y for x in each for y in x], np.int64)
            lens.append(np.diff(ends, prepend=0))
            flat.append(ids)
        return np.concatenate(lens), np.concatenate(flat)

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def simple(self, text: str, low: str) -> bool:
        if any(t in low for t in self.added):
            return False
        return text.isascii() or bool(self.plain[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lows = [x.lower() for x in texts]
        simple = [self.simple(x, low) for x, low in zip(texts, lows)]
        easy = [low for low, ok in zip(lows, simple) if ok]
        found = iter(self._split(easy) if easy else [])
        return [next(found) if ok else self.alone(x) for x, ok in zip(texts, simple)]

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        split = Split(texts, "clip")
        if not len(split.starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        keys, first, which = split.distinct()
        starts, lens = split.starts[first], (split.ends - split.starts)[first]
        row = self.memo.find(keys)
        new, old = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
        if not split.confirmed(first, which) or not self._known(split.cp, starts[old], lens[old], row[old]):
            return [self.alone(x) for x in texts]
        if len(new):
            row[new] = self.memo.put(keys[new], *self.words([split.piece(k) for k in first[new]]))
            at, _ = ragged(starts[new], lens[new])
            self.memo.words.add(lens[new], split.cp[at])
        at, ends = picked(self.memo.ids.offsets[: self.memo.ids.n + 1], row[which])
        out = self.memo.ids.flat[at]
        cuts = np.concatenate([[0], ends])[split.bounds]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _known(self, cp: np.ndarray, starts: np.ndarray, lens: np.ndarray, row: np.ndarray) -> bool:
        """Are these words, code point by code point, those that the memo holds in these rows?"""
        held = self.memo.words
        begin = held.offsets[row]
        if (held.offsets[row + 1] - begin != lens).any():
            return False
        return bool((held.flat[ragged(begin, lens)[0]] == cp[ragged(starts, lens)[0]]).all())


@cache
def encoder(path: str, memo: int) -> WordEncoder:
    return WordEncoder(path, memo)


# --- grammar --------------------------------------------------------------------------------------


#: A symbol, and two flags beside it: the end of a document, and the beginning of a pair that may be frequent.
_SYMBOL, _LAST, _LIVE = np.uint32((1 << 30) - 1), np.uint32(1 << 31), np.uint32(1 << 30)


def repair(ids: np.ndarray, last: np.ndarray, first_new: int, params: TokenFileParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, which of them end a document, rules as rows (left, right)).

    Each round counts all pairs in a hashed table and takes exact counts of those that
    may be frequent (at least `share` of the most frequent pair's).  Where two occurrences
    overlap, the more frequent pair is replaced; what is not frequent any more waits for the
    next round.  The most frequent pair is always replaced, so rounds end when
    no pair has `least` occurrences apart from each other.
    """
    bits, made, share, rules = 18, 0, params.share, []
    # a pair that is not frequent once never becomes so: live are the places where a frequent one may begin
    s = ids.astype(np.uint32) | np.where(last, _LAST, _LIVE)
    s[-1:] &= ~_LIVE
    while True:
        at = np.flatnonzero((s & _LIVE) != 0)
        left, right = s[at] & _SYMBOL, s[at + 1] & _SYMBOL
        bins = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)
        counts = np.bincount(bins, minlength=1 << bits)
        least = max(params.least, int(share * counts.max()))
        s[at[(counts < params.least)[bins]]] &= ~_LIVE
        some = np.flatnonzero((counts >= least)[bins])
        at = at[some]
        which, pairs = pd.factorize(left[some].astype(np.uint64) << np.uint64(32) | right[some])
        n = np.bincount(which, minlength=len(pairs))
        s[at[(n < params.least)[which]]] &= ~_LIVE
        ok = (n >= least)[which]
        at, which = at[ok], which[ok]
        # of a pair that overlaps itself, every second one from the left
        at, which = _frequent(at, which, _every_second(at, which), len(pairs), params.least)
        if not len(at):
            if least == params.least:
                return s & _SYMBOL, (s & _LAST) != 0, np.concatenate([np.zeros((0, 2), np.uint32), *rules])
            share = 0  # only chance meetings in the table reached the part of the most frequent
            continue
        share = params.share
        at, which = _frequent(at, which, _winners(at, which), len(pairs), params.least)
        used, which = np.unique(which, return_inverse=True)
        rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        ends = s[at + 1] & _LAST
        s[at] = (first_new + made + which).astype(np.uint32) | np.where(ends, _LAST, _LIVE)
        made += len(used)
        before = at[at > 0] - 1
        s[before] |= np.where(s[before] & _LAST, np.uint32(0), _LIVE)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]


def _every_second(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of runs of places one after the other with the same pair: the first, the third and so on."""
    run = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(which) != 0)])[: len(at)])
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return place % 2 == 0


def _winners(at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places that can be replaced together: of two that overlap, that of the more frequent pair."""
    n = np.bincount(which)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    own, out, open_ = rank[which], np.zeros(len(at), bool), np.ones(len(at), bool)
    touch = np.diff(at) == 1
    for _ in range(3):  # what is still open then waits for the next round
        value = np.where(open_, own, -1)
        beats_next, beats_last = np.ones(len(at), bool), np.ones(len(at), bool)
        beats_next[:-1] = ~touch | (value[:-1] > value[1:])
        beats_last[1:] = ~touch | (value[1:] > value[:-1])
        won = open_ & beats_next & beats_last
        out |= won
        open_ &= ~won
        open_[1:] &= ~(touch & won[:-1])
        open_[:-1] &= ~(touch & won[1:])
    return out


def _frequent(at: np.ndarray, which: np.ndarray, keep: np.ndarray, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the kept places those whose pair has `least` of them."""
    at, which = at[keep], which[keep]
    ok = (np.bincount(which, minlength=pairs) >= least)[which]
    return at[ok], which[ok]


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    """The number of ids that each rule stands for; rules only name earlier rules."""
    out = np.ones(first_new + len(rules), np.int64)
    out[first_new:] = 0  # unknown yet
    open_ = np.arange(len(rules))
    while len(open_):
        left, right = out[rules[open_, 0]], out[rules[open_, 1]]
        known = (left > 0) & (right > 0)
        out[first_new + open_[known]] = (left + right)[known]
        open_ = open_[~known]
    return out[first_new:]


def expand(symbols: np.ndarray, rules: np.ndarray, first_new: int) -> np.ndarray:
    while True:
        big = symbols >= first_new
        if not big.any():
            return symbols
        ends = np.cumsum(1 + big)
        out = np.zeros(int(ends[-1]), np.uint32)
        at = ends - 1 - big
        rule = symbols[big] - first_new
        out[at[~big]] = symbols[~big]
        out[at[big]], out[at[big] + 1] = rules[rule, 0], rules[rule, 1]
        symbols = out


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True)


def pack_shard(doc_ids: list[int | None], ids: list[np.ndarray], first_new: int, params: TokenFileParams) -> bytes:
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    last = np.zeros(int(lens.sum()), bool)
    last[np.cumsum(lens) - 1] = True
    symbols, last, rules = repair(np.concatenate(ids), last, first_new, params)
    per = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    head = _packed(b"".join([
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        lens.astype("<u4").tobytes(), per.astype("<u4").tobytes(), rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(),
        expansion_lengths(rules, first_new).astype("<u4").tobytes()]))
    blocks = [_packed(symbols[k : k + params.block].astype("<u4").tobytes()) for k in range(0, len(symbols), params.block)]
    sizes = np.array([len(x) for x in blocks], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<6I", len(ids), len(rules), len(symbols), first_new, params.block, len(head)), sizes, head, *blocks])


class Shard:
    """A shard read back; any document, or any run of its ids, expands alone."""

    def __init__(self, data: bytes):
        assert data[:4] == MAGIC, "not a shard"
        n, r, self.m, self.first_new, self.block, size = struct.unpack("<6I", data[4:28])
        blocks = -(-self.m // self.block)
        start = 28 + 4 * blocks + size
        self.data = data
        self.places = start + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", blocks, 28).astype(np.int64))])
        body, at = _unpacked(data[start - size : start], 17 * n + 12 * r), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.lens, self.per = take("<u4", n), take("<u4", n)
        left, right = take("<u4", r), take("<u4", r)
        self.rules, self.sizes = np.stack([left, right], axis=1), take("<u4", r)
        self.ends = np.concatenate([[0], np.cumsum(self.per.astype(np.int64))])

    def symbols(self, a: int, b: int) -> np.ndarray:
        """Symbols a:b; only the blocks that hold them are unpacked."""
        if a == b:
            return np.zeros(0, np.uint32)
        first, stop = a // self.block, -(-b // self.block)
        raw = b"".join(_unpacked(self.data[self.places[k] : self.places[k + 1]], 4 * min(self.block, self.m - k * self.block)) for k in range(first, stop))
        return np.frombuffer(raw, "<u4")[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols(self.ends[k], self.ends[k + 1]), self.rules, self.first_new)

    def all(self) -> list[np.ndarray]:
        """Every document: each rule that a symbol names is expanded once, and its ids are copied from there."""
        symbols = self.symbols(0, self.m)
        big = symbols >= self.first_new
        used, which = np.unique(symbols[big], return_inverse=True)
        flat = np.concatenate([expand(used, self.rules, self.first_new), symbols[~big]])
        size, begin = np.ones(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        own = self.sizes[used - self.first_new].astype(np.int64)
        size[big], begin[big] = own[which], (np.cumsum(own) - own)[which]
        begin[~big] = int(own.sum()) + np.arange(int((~big).sum()))
        return np.split(flat[ragged(begin, size)[0]], np.cumsum(self.lens.astype(np.int64))[:-1])

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start:stop of document k, expanding only the symbols that cover them."""
        own = self.symbols(self.ends[k], self.ends[k + 1])
        size = np.ones(len(own), np.int64)
        big = own >= self.first_new
        size[big] = self.sizes[own[big] - self.first_new]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return expand(own[a:b], self.rules, self.first_new)[skip : skip + stop - start]


# --- files ----------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, params: TokenFileParams = TokenFileParams(),
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all docs below folder; returns the index of shards, stored.

    tokenizer: a file of the tokenizers library, the same on every executor.
    """
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumns({"z": F.col("doc_id").isNull(), "x": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    order = ["z", "doc_id", "x", "r"]
    laid = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def write(batches):
        words, out = encoder(tokenizer, params.memo), Appender(folder, ".grp", params.file_bytes)
        first_new, end = len(words.word_end), np.array([params.end_id], np.uint32)
        docs_held, ids_held, size, shard, found, part = [], [], 0, 0, [], 0

        def close():
            nonlocal docs_held, ids_held, size, shard
            data = pack_shard(docs_held, ids_held, first_new, params)
            file, at = out.add(data)
            found.append((part, shard, len(docs_held), size, file, at, len(data)))
            docs_held, ids_held, size, shard = [], [], 0, shard + 1

        for batch in batches:
            doc_ids = iter(batch["doc_id"].to_pylist())
            part = batch["part"][0].as_py() if len(batch) else part
            for group in text_passes(batch["text"].to_pylist()):
                for ids in words.encode(group):
                    docs_held.append(next(doc_ids))
                    ids_held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= params.shard_ids:
                        close()
        if docs_held:
            close()
        out.close()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["part", "shard", "docs", "tokens", "file", "offset", "length"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 7, kinds)], names)

    return shared.stored(laid.mapInArrow(write, INDEX), "token-index")


def read_tokens(index: DataFrame, params: TokenFileParams = TokenFileParams()) -> DataFrame:
    """Per document, from the files: doc_id, its place (part, shard, k), n_tokens, ids_crc32."""

    def read(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("file", "offset", "length", "part", "shard")))

        for row, data in ranged_reads(rows(), 0, shared.BATCH_BYTES):
            held = Shard(data)
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in held.all()]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.doc_ids, pa.int64()), pa.array([row[3]] * n, pa.int32()), pa.array([row[4]] * n, pa.int32()),
                 pa.array(range(n), pa.int32()), pa.array(held.lens.astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "shard", "k", "n_tokens", "ids_crc32"])

    return read_tasks(index.select("file", "offset", "length", "part", "shard"), params.task_bytes).mapInArrow(read, READ)


def with_starts(index: DataFrame, found: DataFrame) -> DataFrame:
    """found with ``start``: the ids of all documents before each one.

    Shards are summed first (the index has their totals); the prefix sum over
    partitions is over one row a partition, the others run within one partition.
    """
    parts = index.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part0 = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part0"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard0 = index.select("part", "shard", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("shard0"))
    run = Window.partitionBy("part", "shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = found.withColumn("own0", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    # estimates for what Python reads come from the small index: without the hint, all documents would be broadcast
    places = shard0.join(part0.hint("merge"), "part").hint("merge")
    return own.join(places, ["part", "shard"]).withColumn(
        "start", (F.col("part0") + F.col("shard0") + F.col("own0")).cast("long"))
