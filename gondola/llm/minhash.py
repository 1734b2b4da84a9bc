"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles; texts with equal sets are one
   class (a group of copies of any size is one row from here on).
2. Classes that agree on a band of their MinHash signature meet in a bucket.
   Each is compared with the bucket's hub, the class that shares most buckets, so a
   bucket of m classes makes m - 1 candidates, not m(m-1)/2.
3. Candidates are compared by signature, a batch of hashes at a time.  After each
   batch the posterior of the similarity (uniform prior) is known in closed form;
   a pair is dropped once P(similarity >= threshold) is below the miss probability.
4. Survivors are verified on their full shingle sets: a hub's set travels once for each block
   of its partners, a partner's once.
5. Links give components.  Within a bucket, classes of different components that
   were not yet compared are compared in blocks of bounded size by signature, in
   the first band that they share, and pruned in the same way.  Classes with a
   survivor go, with their full sets, through the blocks once more: intersections
   of a whole block are one matrix product, and each class with links gives one
   edge.  Pairs are never emitted.  A pair within one component can no longer
   change the result and is left out.

Chance of missing a link: that no band agrees, (1 - s**rows)**bands for similarity
s, at most 4e-12 for the parameters used at 0.85 and 6e-9 at 0.8, plus the
chosen miss probability of the pruning.

Defined results: null and empty texts and texts without words have empty sets and
link with nothing.  Rows with null ids keep their class, but a null is never the
smallest id unless the whole class has null ids.  Repeated rows share a class.  An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from gondola.llm import shared
from gondola.llm.embed_dedup import forest
from gondola.llm.words import shingle_sets


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    percent: int = 80  #: link when 100 * intersection >= percent * union
    rows: int = 4
    bands: int = 36
    batch: int = 24  #: hashes compared between two looks at the posterior
    miss: float = 1e-9  #: chance of a link below which a pair is dropped
    block: int = 256  #: classes of a bucket that one comparison block takes

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, m): after n hashes a pair needs m matches.

        With a uniform prior, P(s >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            m, tail = 0, (1 - t) ** (n + 1)
            while tail < self.miss:
                m += 1
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, k, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of len(a) hash functions over the shingles, in bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(out, (low[None, k : k + 4096] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def profiles(params: MinHashParams):
    """UDF: text -> struct(n shingles, class id, band hashes, signature)."""
    a, b = _coefficients(params.hashes)

    @F.arrow_udf("struct<n: bigint, cid: bigint, bands: array<bigint>, sig: binary>")
    def profile(texts: pa.Array) -> pa.Array:
        n, cid, bands, sigs = [], [], [], []
        for s in shingle_sets(texts, params.shingle):
            n.append(len(s))
            if not len(s):
                cid.append(None), bands.append(None), sigs.append(None)
                continue
            # low bits: less to ship; a chance match only keeps a pair
            sig = signature(s, a, b).astype(np.uint16)
            rows = sig.reshape(params.bands, params.rows)
            cid.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            bands.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], np.uint64).view(np.int64))
            sigs.append(sig.tobytes())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["n", "cid", "bands", "sig"],
        )

    return profile


def sets(params: MinHashParams):
    """UDF: text -> its sorted distinct shingle hashes."""

    @F.arrow_udf(ArrayType(LongType()))
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(texts, params.shingle)], pa.list_(pa.int64()))

    return shingles


def survive(left: np.ndarray, right: np.ndarray, params: MinHashParams) -> np.ndarray:
    """Which pairs of signature rows are still possible links after all batches."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in params.least_matches():
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _matrix(column: pa.Array, params: MinHashParams) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, params.hashes)


def possible(params: MinHashParams):
    """UDF: do two signatures leave a link possible?"""

    @F.arrow_udf("boolean")
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        if len(left):
            out[survive(_matrix(left, params), _matrix(right, params), params)] = True
        return pa.array(out)

    return check


def _full_sets(texts: DataFrame, wanted: DataFrame, params: MinHashParams) -> DataFrame:
    """(cid, set) of the wanted class ids; texts has one text or, of repeated rows, equal texts for each."""
    return texts.join(wanted, "cid").select("cid", sets(params)("text").alias("set")).dropDuplicates(["cid"])


def _similar(params: MinHashParams):
    """mapInArrow function over rows of (hub, part), the hub's set first: links (a, b) of the hub to the partners behind it.

    Holds one set of a hub and one batch, whatever a hub's number of partners.
    """

    def run(batches):
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            sets_, out = batch["set"], []
            for k, (side, lead, cid) in enumerate(zip(*(batch[c].to_pylist() for c in ("side", "lead", "cid")))):
                each = sets_[k].values.to_numpy().view(np.uint64)
                if side == 0:
                    hub, own = lead, each.copy()
                    continue
                assert hub == lead, "a hub's set comes before its partners"
                at = np.minimum(own.searchsorted(each), len(own) - 1)
                common = int((own[at] == each).sum())
                if 100 * common >= params.percent * (len(own) + len(each) - common):
                    out.append((min(lead, cid), max(lead, cid)))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, params: MinHashParams, name: str) -> DataFrame:
    """Links (a, b) among the pairs (lead, cid) whose full shingle sets are similar enough.

    A partner's set is shuffled once, a hub's once for each `block` partners.
    """
    pairs = shared.stored(pairs, f"{name}-pairs")
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / params.block).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "lead").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(9)), "parts").cast("int"))
    # an exchange of its own, so that a hub's pairs need not lie in one task before it
    hubs = dealt.select("lead", "part").repartition("lead", "part").distinct().select("lead", "part", F.lit(0).alias("side"), F.col("lead").alias("cid"))
    rows = hubs.unionByName(dealt.select("lead", "part", F.lit(1).alias("side"), "cid"))
    full = shared.stored(_full_sets(texts, rows.select("cid").distinct(), params), f"{name}-sets")
    laid = rows.join(full, "cid").select("lead", "part", "side", "cid", "set").repartition("lead", "part").sortWithinPartitions("lead", "part", "side")
    return shared.stored(laid.mapInArrow(_similar(params), "a bigint, b bigint"), f"{name}-links")


def _by_block(work):
    """mapInArrow function that gives work() the rows of one block at a time; rows are sorted by block."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = t["block"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield work(t.slice(s, e - s))
            held = t.slice(cuts[-1])
        if held is not None and len(held):
            yield work(held)

    return run


def _survivors(params: MinHashParams):
    """Of a block: the classes with a possible link to another component, met first in this band.

    A block holds probes (side 1) and members of the hub's component (side 0), or
    two groups of probes (sides 1 and 2).
    """

    def work(t: pa.Table) -> pa.RecordBatch:
        side, root, cid = (t[c].to_numpy() for c in ("side", "root", "cid"))
        band, block = t["band"][0].as_py(), t["block"][0].as_py()
        sig = _matrix(t["sig"].combine_chunks(), params)
        bands = sig.reshape(len(sig), params.bands, params.rows)
        probe, rest = np.flatnonzero(side == 1), np.flatnonzero(side != 1)
        rest = rest if len(rest) else probe
        needed = np.zeros(len(sig), bool)
        for i in probe:
            other = rest[(root[rest] != root[i]) & ((cid[rest] > cid[i]) | (side[rest] != 1))]
            if band and len(other):
                other = other[~(bands[other, :band] == bands[i, :band]).all(axis=2).any(axis=1)]
            if len(other):
                kept = other[survive(np.broadcast_to(sig[i], (len(other), params.hashes)), sig[other], params)]
                if len(kept):
                    needed[i] = needed[kept] = True
        out = cid[needed]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), block), pa.int64()), pa.array(out, pa.int64())], ["block", "cid"])

    return _by_block(work)


def _linked(params: MinHashParams):
    """Of a block with full sets: one edge (a, b) from each class with links to the smallest of its local component."""

    def work(t: pa.Table) -> pa.RecordBatch:
        cid, sets_ = t["cid"].to_numpy(), t["set"].combine_chunks()
        order = np.argsort(cid, kind="stable")
        cid = cid[order]
        each = [sets_[int(k)].values.to_numpy() for k in order]
        size = np.array([len(x) for x in each])
        values, code, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(each)), size)
        shared_by = n[code] > 1  # a shingle of one class alone is in no intersection
        row, column = row[shared_by], (np.cumsum(n > 1) - 1)[code[shared_by]]
        common = np.zeros((len(each), len(each)))
        for start in range(0, int((n > 1).sum()), 8192):
            part = (column >= start) & (column < start + 8192)
            dense = np.zeros((len(each), 8192), np.float32)
            dense[row[part], column[part] - start] = 1
            common += dense @ dense.T
        link = 100 * common >= params.percent * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(link, False)
        i, j = np.nonzero(link)
        label = forest(len(cid), i, j)
        hit = np.flatnonzero(label != np.arange(len(cid)))
        return pa.RecordBatch.from_arrays([pa.array(cid[label[hit]], pa.int64()), pa.array(cid[hit], pa.int64())], ["a", "b"])

    return _by_block(work)


def _blocks(members: DataFrame, roots: DataFrame, params: MinHashParams) -> DataFrame:
    """(block, band, side, cid, root): buckets with classes of several components, dealt to blocks of bounded size."""
    root = roots.withColumnRenamed("node", "cid")
    hubs = members.where("cid = lead").join(root, "cid", "left").select("h", F.coalesce("root", "cid").alias("hub"))
    others = members.where("cid <> lead").join(root, "cid", "left").select("h", "band", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = others.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h").join(hubs, "h")
    sized = others.join(mixed, "h").withColumn("probe", F.col("root") != F.col("hub"))
    counts = sized.groupBy("h").agg(F.count_if("probe").alias("np"), F.count_if(~F.col("probe")).alias("nr"))
    blocks = lambda n: F.ceil(F.col(n) / params.block).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("cid", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")
    x = sized.join(counts, "h").withColumns({"kb": blocks("np"), "lb": blocks("nr")}).withColumns({"p": spread("kb"), "q": spread("lb")})
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["h", "band", "cid", "root"]
    first = x.where("not probe").select(*keep, F.lit(0).alias("side"), "q", F.explode(upto("kb")).alias("p"))
    probes = x.where("probe")
    across = probes.select(*keep, F.lit(1).alias("side"), "p", F.explode(upto("lb")).alias("q"))
    within = probes.select(*keep, "p", F.explode(upto("kb")).alias("o")).select(
        *keep, F.when(F.col("p") <= F.col("o"), 1).otherwise(2).alias("side"),
        F.least("p", "o").alias("p"), (-1 - F.greatest("p", "o")).alias("q"))
    return first.unionByName(across).unionByName(within).select(F.xxhash64("h", "p", "q").alias("block"), "band", "side", "cid", "root")


def near_duplicates(docs: DataFrame, params: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component (smallest id reachable), row_key, first.

    ``row_key`` is a hash of id and text; ``first`` marks one row_key of each
    component (the smallest id, nulls last), and every row without shingles.
    """
    shared.bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    slim = shared.stored(
        docs.select(F.col(id_col).alias("_id"), key.alias("_k"), profiles(params)(F.col(text_col)).alias("p")).select("_id", "_k", "p.*"),
        "minhash-profiles")
    classes = slim.where("cid is not null")
    # rows of a class have equal sets, hence equal bands: those of any row will do
    # aggregated before any join: a class of many copies is one row from here on
    one = shared.stored(classes.groupBy("cid").agg(
        F.min("_id").alias("rep"), F.min("_k").alias("_k"), F.min_by("bands", "_k").alias("bands"), F.min("sig").alias("sig"),
        F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_k")).alias("first")), "minhash-each")
    banded = shared.stored(one.select("cid", F.posexplode("bands").alias("band", "h")), "minhash-bands")
    buckets = banded.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    met = shared.stored(banded.join(buckets, "h"), "minhash-buckets")
    shared.drop_path(docs.sparkSession, banded.gondola_path)
    shares = met.groupBy("cid").agg(F.sum("size").alias("shares"))
    hub = met.join(shares, "cid").groupBy("h").agg(F.max(F.struct("shares", "cid")).alias("m")).select("h", F.col("m.cid").alias("lead"))
    members = shared.stored(met.drop("size").join(hub, "h"), "minhash-members")
    shared.drop_path(docs.sparkSession, met.gondola_path)
    busy = members.select("cid").distinct()
    picked = shared.stored(one.select("cid", "_k", "sig").join(busy, "cid"), "minhash-signatures")
    sigs = picked.select("cid", "sig")
    texts = docs.select(key.alias("_k"), F.col(text_col).alias("text")).join(picked.select("cid", "_k"), "_k")

    # a pair that meets in several buckets, with either class as the hub, is one pair
    star = members.where("cid <> lead").groupBy(F.least("lead", "cid").alias("a"), F.greatest("lead", "cid").alias("b")).agg(F.min("lead").alias("lead"))
    star = star.select("lead", F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("cid"))
    near = star.join(sigs.select(F.col("cid").alias("lead"), F.col("sig").alias("sa")), "lead").join(
        sigs.select("cid", F.col("sig").alias("sb")), "cid").where(possible(params)("sa", "sb")).select("lead", "cid")
    links = _verified(near, texts, params, "minhash-star")
    roots = shared.stored(shared.components(links, "minhash-roots"), "minhash-roots")
    dealt = shared.stored(_blocks(members, roots, params), "minhash-blocks")
    if not dealt.isEmpty():
        laid = dealt.join(sigs, "cid").repartition("block").sortWithinPartitions("block")
        needed = shared.stored(laid.mapInArrow(_survivors(params), "block bigint, cid bigint").distinct(), "minhash-needed")
        full = shared.stored(_full_sets(texts, needed.select("cid").distinct(), params), "minhash-sets")
        exact = needed.join(full, "cid").repartition("block").sortWithinPartitions("block")
        found = shared.stored(exact.mapInArrow(_linked(params), "a bigint, b bigint").distinct(), "minhash-links")
        roots = shared.stored(shared.components(links.unionByName(found), "minhash-roots"), "minhash-roots")

    labelled = one.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    named = shared.stored(labelled.select("cid", "root").join(lowest, "root"), "minhash-classes")
    # the first of a component out of the firsts of its classes; rows meet it by their own key, not by their component's
    firsts = one.select("cid", "first").join(named.select("cid", "root"), "cid").groupBy("root").agg(F.min("first").alias("f"))
    rows = slim.select("_id", "_k", "n", "cid").join(named.select("cid", "component"), "cid", "left")
    return rows.join(firsts.select(F.col("f._k").alias("_k"), F.lit(True).alias("hit")), "_k", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("cid").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component"),
        F.col("_k").alias("row_key"), (F.col("hit").isNotNull() | F.col("cid").isNull()).alias("first"))


def keep_firsts(docs: DataFrame, params: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: one row of each component stays, and every row without shingles.

    Repeated rows (equal id and text) with shingles count as copies: one stays, where other columns
    differ that with the lowest hash of all columns.  A row is known by two hashes of id and text, so that two
    texts which share the first one both stay.
    """
    found = near_duplicates(docs, params, id_col, text_col)
    stay = found.where("first").select(F.col("row_key").alias("_k"), F.col("n_shingles").alias("_n")).distinct()
    own = (F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64(*own).alias("_k"), F.xxhash64(F.lit(2), *own).alias("_k2"), F.xxhash64(F.lit(3), *docs.columns).alias("_o"))
    kept = keyed.join(stay, "_k")
    once = kept.where("_n > 0").groupBy("_k", "_k2").agg(F.min_by("_doc", "_o").alias("_doc"))
    return once.select("_doc").unionByName(kept.where("_n = 0").select("_doc")).select("_doc.*")
