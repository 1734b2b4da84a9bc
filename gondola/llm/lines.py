"""Line dedup with sharded minimal perfect hashes.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, A-Z in lower case; keys
of `least_chars` code points or more count.  A key that `least_docs` documents hold
loses its lines in all documents but that with the largest id.

1. Documents are written in blocks (Arrow streams) to files in the shared folder; beside each block
   go the 128-bit digests of its distinct keys, with the number of its documents that hold them and the largest id.
2. Spark sums these by digest, partial sums first, so a line that every document has costs one row a block.
3. Digests found in `index_docs` documents are dealt to shards.  A task builds a shard's minimal perfect hash: levels of
   bits with ranks (about 4 bits a key), which give a digest its slot in three arrays: 64-bit
   fingerprint, document count, largest id.  What fewer documents hold is not indexed: no line of it goes.
4. Blocks' digests meet the shards' arrays (a task holds one shard at a time); a wrong
   fingerprint is a key that is not indexed.  Only digests that drop lines go back, to their block.
5. Tasks read the blocks by ranges, drop lines and give the documents back.  Texts are never shuffled and lines never joined.

A task's memory is one shard or one block (a batch of bounded bytes, or one longer text).
Two keys are taken as one with a chance of 2**-128 a pair.

Defined results: a null or empty text is one empty line, and comes back as an empty text.
Repeated rows are documents of their own, each counts; those that share the largest id all keep the line.
A null id is smaller than all others; a key that only rows without id hold stays.  Columns of docs travel
inside a struct, so names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gondola.llm import shared
from gondola.llm.files import Appender, opened, ranged_reads, read_tasks
from gondola.llm.words import mix

WHITE = b" \t\n\x0b\x0c\r"
#: Stands for the id of rows without one.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class LineParams:
    least_chars: int = 20
    least_docs: int = 3
    index_docs: int = 2  #: the index answers for any least_docs from here on
    shard_keys: int = 1 << 20
    file_bytes: int = 128 << 20
    task_bytes: int = 16 << 20  #: of packed blocks that one task reads


def digests(text: str | None, least_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(WHITE).lower()  # of bytes: A-Z alone
        # no code point has more than four bytes
        long_enough = len(key) >= least_chars and (len(key) >= 4 * least_chars or key.isascii() or len(key.decode()) >= least_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


# --- blocks ---------------------------------------------------------------------------------------


def packed(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


PROBES = "block long, file string, offset long, length long, h1 long, h2 long, n int, last long"


def write_blocks(docs: DataFrame, folder: str, id_col: str, text_col: str, params: LineParams) -> DataFrame:
    """Write docs in blocks below folder; returns (PROBES), stored: a row with file for each block and one with h1, h2 for each key of a block."""
    shared.bounded_batches(docs.sparkSession)

    def write(batches):
        out, part, k = Appender(folder, ".docs", params.file_bytes), TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in PROBES.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            if not len(batch):
                continue
            held: dict[bytes, list[int]] = {}
            for own, text in zip(batch["id"].to_pylist(), batch["doc"].field(text_col).to_pylist()):
                own = NO_ID if own is None else own
                for d in set(digests(text, params.least_chars)) - {None}:
                    at = held.setdefault(d, [0, own])
                    at[0] += 1
                    at[1] = max(at[1], own)
            data = packed(batch)
            file, offset = out.add(data)
            block, k = (part << 32) + k, k + 1
            both = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, file, offset, len(data), None, None, None, None), kinds)], names)
            empty = pa.nulls(len(held))
            columns = [np.full(len(held), block), empty, empty, empty, both[:, 0], both[:, 1], [x[0] for x in held.values()], [x[1] for x in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) if x is empty else pa.array(x, t) for x, t in zip(columns, kinds)], names)
        out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*docs.columns).alias("doc"))
    return shared.stored(rows.mapInArrow(write, PROBES), "line-keys")


# --- shards ---------------------------------------------------------------------------------------


class Shard:
    """A minimal perfect hash of digests (h1, h2), and the arrays that it indexes.

    A level holds the keys that no other key meets in it; the others go on to the next one.  A key's slot is the
    rank of its bit.  Of digests with equal h1 all but one are kept apart (`spare`).
    """

    def __init__(self, sizes, bits, fingerprint, count, last, spare):
        self.sizes, self.bits, self.fingerprint, self.count, self.last, self.spare = sizes, bits, fingerprint, count, last, spare
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray, gamma: float = 1.5) -> Shard:
        keys, first = np.unique(h1, return_index=True)
        again = np.setdiff1d(np.arange(len(h1)), first)
        spare = np.stack([h1[again].view(np.int64), h2[again].view(np.int64), count[again].astype(np.int64), last[again]])
        sizes, words, left = [], [], keys
        while len(left):
            size = -(-max(int(gamma * len(left)), 8) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        n = len(keys)
        out = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]), np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.int64), spare)
        slot = out.slots(keys)
        out.fingerprint[slot], out.count[slot], out.last[slot] = h2[first], count[first], last[first]
        return out

    def slots(self, h1: np.ndarray) -> np.ndarray:
        """The slot of each key; for other values any slot, or -1."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self._place(h1[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left, base = left[~hit], base + size
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold it, largest id) of each digest; 0 documents for one that is not indexed."""
        at = self.slots(h1)
        hit = (at >= 0) & (self.fingerprint[at] == h2) if len(self.fingerprint) else np.zeros(len(h1), bool)
        count, last = np.zeros(len(h1), np.int64), np.full(len(h1), NO_ID)
        count[hit], last[hit] = self.count[at[hit]], self.last[at[hit]]
        for a, b, n, top in self.spare.T.tolist():
            same = (h1.view(np.int64) == a) & (h2.view(np.int64) == b)
            count[same], last[same] = n, top
        return count, last

    def data(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, bits=self.bits, fingerprint=self.fingerprint, count=self.count, last=self.last, spare=self.spare)
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[x] for x in ("sizes", "bits", "fingerprint", "count", "last", "spare")))


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(value, part of a batch with it) of batches that are sorted by a column."""
    for batch in batches:
        values = batch[by].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else []
        for a, b in zip(edges, edges[1:]):
            yield int(values[a]), batch.slice(a, b - a)


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part[name].to_numpy(zero_copy_only=False)


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards))


SHARDS = "shard long, file string, offset long, length long"


def build_index(probes: DataFrame, folder: str, params: LineParams) -> tuple[DataFrame, int]:
    """Shards (SHARDS) of all keys that `index_docs` documents hold, written below folder, and their number."""
    counts = shared.stored(
        probes.where("h1 is not null").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= params.index_docs), "line-counts")
    shards = counts.count() // params.shard_keys + 1

    def build(batches):
        out, found, held, now = Appender(folder, ".shard", params.file_bytes), [], [], None

        def close():
            h1, h2, n, last = (np.concatenate([_column(x, c) for x in held]) for c in ("h1", "h2", "n", "last"))
            data = Shard.build(h1.view(np.uint64), h2.view(np.uint64), n, last).data()
            found.append((now, *out.add(data), len(data)))

        for shard, part in _runs(batches, "shard"):
            if held and shard != now:
                close()
                held = []
            now = shard
            held.append(part)
        if held:
            close()
        out.close()
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["shard", "file", "offset", "length"])

    dealt = counts.withColumn("shard", shard_of(shards)).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return shared.stored(dealt.mapInArrow(build, SHARDS), "line-shards"), shards


HITS = "block long, h1 long, h2 long, last long"


def drops(probes: DataFrame, index: DataFrame, shards: int, params: LineParams) -> DataFrame:
    """(HITS): the digests whose lines go, with the largest id, for each block that asked."""
    tasks = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-tasks // shards)  # tasks that share a shard
    asked = probes.where("h1 is not null").select("block", "h1", "h2", shard_of(shards).alias("shard"))
    place = F.col("shard") * parts + F.pmod(F.xxhash64("block"), F.lit(parts))
    laid = asked.join(index, "shard").repartitionById(shards * parts, place.cast("int")).sortWithinPartitions("shard")

    def probe(batches):
        now, held = None, None
        for shard, part in _runs(batches, "shard"):
            if shard != now:
                now, held = shard, Shard.read(_range(*(part[c][0].as_py() for c in ("file", "offset", "length"))))
            h1, h2 = _column(part, "h1"), _column(part, "h2")
            count, last = held.probe(h1.view(np.uint64), h2.view(np.uint64))
            hit = count >= params.least_docs
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (_column(part, "block"), h1, h2, last)], ["block", "h1", "h2", "last"])

    return laid.mapInArrow(probe, HITS)


def _range(file: str, offset: int, length: int) -> bytes:
    system, path = opened(file)
    with system.open_input_file(path) as source:
        return source.read_at(length, offset)


# --- documents ------------------------------------------------------------------------------------


def thinned(text: str | None, own: int | None, gone: dict[bytes, int], least_chars: int) -> tuple[str, int, int]:
    """(what stays of a text, its lines, those that go): gone has the largest id of each digest that loses lines."""
    own = NO_ID if own is None else own
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    kept = [line for line, d in zip(lines, digests(text, least_chars)) if d is None or gone.get(d, own) == own]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def deduped(docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_lines, n_dropped) for each row of docs: doc is the row as a struct, its text without the lines that go."""
    spark = docs.sparkSession
    probes = write_blocks(docs, shared.work_path(spark, "line-blocks"), id_col, text_col, params)
    index, shards = build_index(probes, shared.work_path(spark, "line-shards"), params)
    # a block has a bounded number of keys: those of one batch, or of one long text
    gone = drops(probes, index, shards, params).groupBy("block").agg(F.collect_list(F.struct("h1", "h2", "last")).alias("gone"))
    blocks = probes.where("file is not null").select("block", "file", "offset", "length")
    asked = shared.stored(blocks.join(gone, "block", "left").drop("block"), "line-drops")

    def apply(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), map(_gone, batch["gone"]))

        for (_, _, _, gone), data in ranged_reads(rows(), 0, shared.BATCH_BYTES):
            batch = unpacked(data)
            doc = batch["doc"]
            found = [thinned(x, own, gone, params.least_chars) for x, own in zip(doc.field(text_col).to_pylist(), batch["id"].to_pylist())]
            texts, n_lines, n_dropped = zip(*found)
            columns = [pa.array(texts, f.type) if f.name == text_col else doc.field(i) for i, f in enumerate(doc.type)]
            kept = pa.StructArray.from_arrays(columns, fields=list(doc.type))
            yield pa.RecordBatch.from_arrays([kept, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc", "n_lines", "n_dropped"])

    out = T.StructType([T.StructField("doc", docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return read_tasks(asked.select("file", "offset", "length", "gone"), params.task_bytes).mapInArrow(apply, out)


def _gone(found: pa.ListScalar) -> dict[bytes, int]:
    """The largest id of each digest of a list of (h1, h2, last)."""
    if not found.is_valid:
        return {}
    h1, h2, last = (x.to_numpy() for x in found.values.flatten())
    raw = np.stack([h1, h2], 1).astype("<i8").tobytes()
    return dict(zip((raw[i : i + 16] for i in range(0, len(raw), 16)), last.tolist()))
