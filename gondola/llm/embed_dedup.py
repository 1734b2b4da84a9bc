"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are divided by their largest component and scaled to unit length (double
precision), and quantised once to int8 with one scale per vector: v = s*q + e.  For two vectors

    |v.w - s*t*(q.r)| <= |e_v|*|t*r| + |e_w|*|s*q| + |e_v|*|e_w|

and the right side is known per vector.  So a pair whose quantised product plus
bound stays below the threshold is no link, one whose product minus bound reaches
it is one, and only the pairs between are open: these, and no others, are computed again in double precision.

Within a label, vectors are dealt to tiles of bounded size, and pairs of tiles go to
tasks: a hot label only means more pairs of tiles.  What is shuffled there is the
int8 form (one byte a component, the scale and two lengths).  A pair of tiles gives each vector
its number of sure links, one edge to the smallest vector of its local component, and
whether it has an open pair.  Full vectors are then fetched for the vectors with open
pairs alone, once for each of their pairs of tiles.  Pairs of vectors are never emitted.

Exact copies (equal label and components, told by 128 bits of hash) are one class before the tiles; its
multiplicity enters the counts.  Int8 products are done as float32 matrix
products, which are exact here: 1024 * 127**2 < 2**24 (longer vectors are summed in
slices of 1024 components, in double).

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component, and those with a null label, link with nothing and are their own
component.  Vectors of different length do not link.  Rows that repeat an id count
as separate vectors.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm import shared


@dataclass(frozen=True)
class EmbedParams:
    threshold: float = 0.98
    tile: int = 16384
    block: int = 512  #: rows of one tile that meet the other at a time
    slice: int = 1024  #: components per exact float32 product
    dtype: str = "<f8"  #: how full components are kept


#: Above the rounding of the float32 arithmetic around products and bounds, which are at most about 1.
SLACK = 4e-6


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length in double, however large or small their components are."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> (q as int8, scale, length of the quantised row, length of the error)."""
    scale = np.abs(v).max(axis=1) / 127
    q = np.rint(v / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(v - near, axis=1)


def products(q: np.ndarray, r: np.ndarray, step: int) -> np.ndarray:
    """Exact integer products of all rows (float32 while one slice holds all components)."""
    if q.shape[1] <= step:
        return q @ r.T
    out = np.zeros((len(q), len(r)))
    for k in range(0, q.shape[1], step):
        out += q[:, k : k + step] @ r[:, k : k + step].T
    return out


def screened(one: tuple, two: tuple, params: EmbedParams):
    """Per block of rows of one: (first row, sure links, open pairs) as index pairs; one and two are as of quantise()."""
    r, t, length2, error2 = (np.asarray(x, np.float32) for x in two)
    for k in range(0, len(one[0]), params.block):
        q, s, length1, error1 = (np.asarray(x[k : k + params.block], np.float32) for x in one)
        near = products(q, r, params.slice) * (s[:, None] * t[None, :])
        bound = error1[:, None] * (length2 + error2)[None, :]
        bound += length1[:, None] * error2[None, :]
        bound += np.float32(SLACK)
        high = np.nonzero(near + bound >= params.threshold)
        sure = near[high] - bound[high] >= params.threshold
        yield k, (high[0][sure], high[1][sure]), (high[0][~sure], high[1][~sure])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index of its component, by min-label rounds."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


class Local:
    """Links within a pair of tiles as they are found: their number by weight, and a forest that never holds all of them."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.links, self.label = weight, np.zeros(len(weight)), np.arange(len(weight))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        n = len(self.weight)
        self.links += np.bincount(i, self.weight[j], n) + np.bincount(j, self.weight[i], n)
        a, b = self.label[i], self.label[j]
        apart = a != b
        self.label = forest(n, a[apart], b[apart])[self.label]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the first and of the second tile, and whether both are the same."""
    alone = bool((side == 0).any())
    return np.flatnonzero(side != 2), np.flatnonzero(side != 1 if alone else side == 2), alone


def _matrices(t: pa.Table, column: str, dtype: str):
    """(rows, their vectors) for each length of vector in the table."""
    raw = t[column].combine_chunks()
    lens = np.diff(np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset))
    for size in np.unique(lens):
        rows = np.flatnonzero(lens == size)
        yield rows, np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist()), dtype).reshape(len(rows), -1)


_PAIR = ["lid", "lo", "hi"]  # a label's number and two of its tiles
_SURE = "lid bigint, lo int, hi int, side int, cid bigint, weight bigint, root bigint, links bigint, open boolean"
_LINKS = "cid bigint, root bigint, links bigint"


def _batch(columns: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c) if c else [], kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def _screen(t: pa.Table, params: EmbedParams) -> pa.RecordBatch:
    """Of one pair of tiles in int8, the vectors with sure links (by weight) or open pairs, and their local root."""
    pair = [t[c][0].as_py() for c in _PAIR]
    side, cid, weight, scale, length, error = (t[c].to_numpy() for c in ("side", "cid", "weight", "scale", "length", "error"))
    out = [[] for _ in range(9)]
    for rows, q in _matrices(t, "q", "i1"):
        order = np.argsort(cid[rows], kind="stable")
        rows, q = rows[order], q[order]
        one, two, alone = _sides(side[rows])
        local, doubt = Local(weight[rows]), np.zeros(len(rows), bool)
        parts = lambda at: (q[at], scale[rows[at]], length[rows[at]], error[rows[at]])  # noqa: E731, B023
        for k, sure, open_ in screened(parts(one), parts(two), params):
            i, j = one[sure[0] + k], two[sure[1]]
            keep = i < j if alone else slice(None)
            local.add(i[keep], j[keep])
            i, j = one[open_[0] + k], two[open_[1]]
            keep = i != j if alone else slice(None)
            doubt[i[keep]] = doubt[j[keep]] = True
        hit = np.flatnonzero((local.links > 0) | doubt)
        at = rows[hit]
        values = [*(np.full(len(hit), x) for x in pair), side[at], cid[at], weight[at], cid[rows[local.label[hit]]], local.links[hit].astype(np.int64), doubt[hit]]
        for column, x in zip(out, values):
            column.append(x)
    return _batch(out, _SURE)


def _verify(t: pa.Table, params: EmbedParams) -> pa.RecordBatch:
    """Of the vectors of one pair of tiles that have open pairs, now in full: the links among those pairs."""
    side, cid, weight = (t[c].to_numpy() for c in ("side", "cid", "weight"))
    out = [[], [], []]
    for rows, raw in _matrices(t, "raw", params.dtype):
        order = np.argsort(cid[rows], kind="stable")
        rows, v = rows[order], raw[order].astype(np.float64)
        v /= np.abs(v).max(axis=1)[:, None]
        one, two, alone = _sides(side[rows])
        form, local = quantise(unit(v)), Local(weight[rows])
        for k, _, open_ in screened(tuple(x[one] for x in form), tuple(x[two] for x in form), params):
            i, j = one[open_[0] + k], two[open_[1]]
            if alone:
                i, j = i[i < j], j[i < j]
            for a in range(0, len(i), 65536):
                x, y = v[i[a : a + 65536]], v[j[a : a + 65536]]
                dot = np.einsum("ij,ij->i", x, y)
                ok = dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= params.threshold
                local.add(i[a : a + 65536][ok], j[a : a + 65536][ok])
        hit = np.flatnonzero(local.links)
        for column, x in zip(out, (cid[rows[hit]], cid[rows[local.label[hit]]], local.links[hit].astype(np.int64))):
            column.append(x)
    return _batch(out, _LINKS)


def _by_pair(work, params: EmbedParams):
    """mapInArrow function that gives work() the rows of one pair of tiles at a time; rows are sorted by pair."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in _PAIR])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = keys[:, a].tolist()
                if held and key != now:
                    yield work(pa.Table.from_batches(held), params)
                    held = []
                held, now = [*held, batch.slice(a, b - a)], key
        if held:
            yield work(pa.Table.from_batches(held), params)

    return run


def near_vectors(vectors: DataFrame, params: EmbedParams = EmbedParams(), id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links, component (smallest id reachable, itself included)."""
    shared.bounded_batches(vectors.sparkSession)
    if dict(vectors.dtypes)[vector_col] == "array<float>":
        params = replace(params, dtype="<f4")  # lossless, half the bytes
    c, v = F.col, F.col(vector_col).cast("array<double>")
    usable = (
        F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    # -0.0 and 0.0 are equal components
    clean = F.transform(v, lambda x: x + F.lit(0.0))
    label = F.col(label_col).cast("string")
    rows = shared.stored(vectors.select(
        F.col(id_col).alias("_id"), F.when(usable, F.col(label_col)).alias("label"), F.when(usable, clean).alias("v"),
        F.when(usable, F.xxhash64(label, clean)).alias("k1"), F.when(usable, F.xxhash64(F.lit(7), clean, label)).alias("k2")), "embed-rows")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.count("*").alias("weight"), F.min("_id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"))
    # stored with its number, so that a lost task cannot bring another one
    own = shared.stored(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("f", _forms(params.dtype)("v")).select(
        "cid", "k1", "k2", "weight", "rep", "label", "f.*"), "embed-classes")
    # one row a label; stored with its number
    sizes = shared.stored(own.groupBy("label").agg(F.ceil(F.count("*") / params.tile).cast("int").alias("tiles")).withColumn(
        "lid", F.monotonically_increasing_id()), "embed-labels")
    tiled = own.select("label", "cid", "weight", "q", "scale", "length", "error").join(sizes, "label").withColumn(
        "tile", F.pmod(F.xxhash64("cid", F.lit(3)), "tiles").cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), c("tiles") - 1))).withColumns({
        "lo": F.least("tile", "other"), "hi": F.greatest("tile", "other"),
        "side": F.when(c("tile") == c("other"), 0).when(c("tile") < c("other"), 1).otherwise(2)})
    met = dealt.select(*_PAIR, "side", "cid", "weight", "q", "scale", "length", "error").repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    sure = shared.stored(met.mapInArrow(_by_pair(_screen, params), _SURE), "embed-sure")
    full = sure.where("open").select(*_PAIR, "side", "cid", "weight").join(own.select("cid", "raw"), "cid")
    checked = shared.stored(full.select(*_PAIR, "side", "cid", "weight", "raw").repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(
        _by_pair(_verify, params), _LINKS), "embed-checked")
    found = sure.select("cid", "root", "links").unionByName(checked)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = shared.stored(shared.components(found.select(c("cid").alias("a"), c("root").alias("b")), "embed-roots"), "embed-roots")
    labelled = own.select("cid", "k1", "k2", "weight", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    named = labelled.join(lowest, "root").join(counts, "cid", "left").select(
        "k1", "k2", "component", (F.coalesce("links", F.lit(0)) + c("weight") - 1).alias("n_links"))
    return rows.select("_id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        c("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(c("k1").isNull(), c("_id")).otherwise(c("component")).alias("component"))


def _forms(dtype: str):
    @F.arrow_udf("struct<q: binary, scale: double, length: double, error: double, raw: binary>")
    def forms(v: pa.Array) -> pa.Array:
        flat, offsets = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        lens, starts = np.diff(offsets), (offsets - offsets[0])[:-1]
        n = len(lens)
        q, raw = [b""] * n, [b""] * n
        numbers = np.zeros((3, n))
        for size in np.unique(lens):
            rows = np.flatnonzero(lens == size)
            m = flat[starts[rows][:, None] + np.arange(size)]
            codes, *rest = quantise(unit(m))
            numbers[:, rows] = rest
            kept = m.astype(dtype)
            for k, row in enumerate(rows.tolist()):
                q[row], raw[row] = codes[k].tobytes(), kept[k].tobytes()
        return pa.StructArray.from_arrays([pa.array(q, pa.binary()), *(pa.array(x) for x in numbers), pa.array(raw, pa.binary())],
                                          names=["q", "scale", "length", "error", "raw"])

    return forms
