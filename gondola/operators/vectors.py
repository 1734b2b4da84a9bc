"""The k nearest vectors to each of many questions, exactly, without comparing all pairs.

Angles between vectors obey the triangle inequality.  Vectors are dealt to clusters around centres (a bounded sample of
them); a cluster knows the least and the greatest angle of its members to its centre.  A question meets first the clusters nearest
to it that hold k vectors; its k-th distance there bounds the others: a cluster all of whose
members must be farther is left out, and in the ones that stay so are members whose angle to the centre says it.

Clusters are cut into tiles of bounded size; a task holds one tile and a batch of questions, takes a matrix product and
keeps k rows a question.  Neither a large cluster nor many questions meet in one task.

Defined results: vectors that are null, empty, zero, of another length than the questions', or with null or non-finite numbers are near
to nothing.  Distances are rounded half up; ties go to the smaller id.  Fewer than k vectors: all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.sources.workspace import stored


@dataclass(frozen=True)
class NearParams:
    centres: int = 256  #: at most; a table of so many vectors travels with the tasks
    tile: int = 4096  #: vectors of one tile
    questions: int = 1024  #: that a tile meets at a time
    digits: int = 6
    seed: int = 7

    @property
    def slack(self) -> float:
        """Of angles: what rounding and arccos can move."""
        return 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def usable(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector can be compared."""
    v = F.col(vector)
    good = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _placed(rows: DataFrame, centres: np.ndarray, columns: str) -> DataFrame:
    """rows (id, v) with the nearest centre and the angle to it; a narrow map."""

    def place(batches):
        for batch in batches:
            far = angles(matrix(batch["v"]), centres) if len(batch) else np.zeros((0, 1))
            c = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(c, pa.int32()), pa.array(far[np.arange(len(c)), c], pa.float64())], ["id", "v", "c", "angle"])

    return rows.mapInArrow(place, f"{columns}, c int, angle double")


def _routed(questions: DataFrame, centres: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, k: int, columns: str, slack: float, first: bool) -> DataFrame:
    """(id, v, c, qc, bound): questions at the clusters that they must meet; qc is the angle to the centre.

    first: the nearest ones that hold k vectors.  Else those of the others that the bound (an angle, of the k-th found so far; null: none) does not rule out.
    """

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            far = angles(matrix(batch["v"]), centres)
            order = np.argsort(far, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            near = np.zeros_like(far, bool)
            np.put_along_axis(near, order, before < k, axis=1)
            if first:
                meets, bound = near, np.full(len(far), np.pi)
            else:
                bound = batch["bound"].to_numpy(zero_copy_only=False)
                bound = np.where(np.isnan(bound), np.pi, bound)
                least = np.maximum(0, np.maximum(far - high, low - far))
                meets = ~near & (least <= bound[:, None] + slack)
            q, c = np.nonzero(meets & (sizes > 0))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(q)), batch["v"].take(pa.array(q)), pa.array(c, pa.int32()), pa.array(far[q, c]), pa.array(bound[q])], ["id", "v", "c", "qc", "bound"])

    return questions.mapInArrow(route, f"{columns}, c int, qc double, bound double")


def rounded(distance: np.ndarray, digits: int) -> np.ndarray:
    """half_up() of functions, in numpy."""
    p = 10.0**digits
    return np.sign(distance) * np.floor(np.abs(distance) * p + 0.500001) / p


def _met(asked: DataFrame, tiles: DataFrame, k: int, kind: str, params: NearParams) -> DataFrame:
    """(q, id, distance, compared): the k nearest of a tile for each question that meets it; the first of a question's rows has the pairs that were compared."""
    spread = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t")
    per = tiles.groupBy("c").agg((F.max("t") + 1).alias("tiles"))
    left = tiles.select("c", "t", F.lit(0).alias("side"), "id", "v", "angle", F.lit(None).cast("double").alias("bound"))
    right = asked.join(per, "c").select("c", spread, F.lit(1).alias("side"), "id", "v", F.col("qc").alias("angle"), "bound")
    dealt = left.unionByName(right).repartition("c", "t").sortWithinPartitions("c", "t", "side")

    def meet(batches):
        held, base, ids, angle = None, [], [], []

        def answers(q: pa.RecordBatch):
            m, vectors = matrix(q["v"]), np.concatenate(base)
            own, r = pa.chunked_array(ids).combine_chunks(), np.concatenate(angle)
            qc, bound = q["angle"].to_numpy(), q["bound"].to_numpy()
            out_q, out_i, out_d, out_n = [], [], [], []
            order = np.argsort(r, kind="stable")
            sorted_r = r[order]
            # members whose angle to the centre is too far from the question's are not compared
            lo, hi = np.searchsorted(sorted_r, qc - bound - params.slack, "left"), np.searchsorted(sorted_r, qc + bound + params.slack, "right")
            names = np.array(own.to_pylist(), dtype=object if not pa.types.is_integer(own.type) else np.int64)
            for i in range(len(m)):
                some = order[lo[i] : hi[i]]
                if not len(some):
                    continue
                d = rounded(1 - vectors[some] @ m[i], params.digits)
                if len(d) > k:
                    cut = np.partition(d, k - 1)[k - 1]
                    inside = d <= cut
                    some_in, d_in = some[inside], d[inside]
                else:
                    some_in, d_in = some, d
                best = np.lexsort((names[some_in], d_in))[:k]
                out_q += [i] * len(best)
                out_i += some_in[best].tolist()
                out_d += d_in[best].tolist()
                out_n += [len(some)] + [0] * (len(best) - 1)
            return pa.RecordBatch.from_arrays([q["id"].take(pa.array(out_q, pa.int64())), own.take(pa.array(out_i, pa.int64())), pa.array(out_d, pa.float64()), pa.array(out_n, pa.int64())], ["q", "id", "distance", "compared"])

        for batch in batches:
            key = np.stack([batch[x].to_numpy() for x in ("c", "t", "side")], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(edges, edges[1:]):
                part, at = batch.slice(a, b - a), tuple(key[a].tolist())
                if at[:2] != held:
                    held, base, ids, angle = at[:2], [], [], []
                if at[2] == 0:
                    base.append(matrix(part["v"]))
                    ids.append(part["id"])
                    angle.append(part["angle"].to_numpy())
                elif base:
                    for s in range(0, len(part), params.questions):
                        yield answers(part.slice(s, params.questions))

    return dealt.mapInArrow(meet, f"q {kind}, id {kind}, distance double, compared long")


def nearest(base: DataFrame, questions: DataFrame, k: int, id_col: str, vector: str, params: NearParams = NearParams()) -> DataFrame:
    """(question, id, distance, rank, compared): the k rows of base nearest to each question; compared: how many of base its distance was taken to."""
    spark = base.sparkSession
    kind = base.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, v array<double>"
    slim = lambda x: x.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    some = slim(questions).where("size(v) > 0").select("v").first()
    empty = spark.createDataFrame([], f"question {kind}, id {kind}, distance double, rank int, compared long")
    if some is None:
        return empty
    size = len(some["v"])
    rows, asked = usable(slim(base), "v", size), usable(slim(questions), "v", size)
    sample = rows.orderBy(F.xxhash64("id", F.lit(params.seed))).limit(params.centres).collect()  # bounded: a parameter
    if not sample:
        return empty
    centres = np.array([r["v"] for r in sample])
    centres /= np.sqrt(np.einsum("ij,ij->i", centres, centres))[:, None]
    placed = _placed(rows, centres, columns)
    # tiles by a digest of the id: of bounded size on average, whatever a cluster holds
    kept = stored(placed, "near-placed")
    stats = {r["c"]: r for r in kept.groupBy("c").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}  # one row a centre
    array = lambda key, none: np.array([stats[c][key] if c in stats else none for c in range(len(centres))], float)
    sizes, low, high = array("n", 0), array("low", np.inf), array("high", -np.inf)
    parts = F.element_at(F.array(*[F.lit(int(-(-n // params.tile)) or 1) for n in sizes]), F.col("c") + 1)
    tiles = kept.withColumn("t", F.pmod(F.xxhash64("id"), parts).cast("int"))
    route = lambda q, first: _routed(q, centres, low, high, sizes, k, columns, params.slack, first)
    found = stored(_met(route(asked, True), tiles, k, kind, params), "near-first")
    by_rank = Window.partitionBy("q").orderBy("distance", "id")
    kth = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") == k).select(F.col("q").alias("id"), F.acos(F.greatest(F.lit(-1.0), 1 - F.col("distance") - 2 * 10.0**-params.digits)).alias("bound"))
    rest = _met(route(asked.join(kth, "id", "left"), False), tiles, k, kind, params)
    all_rows = found.unionByName(rest)
    total = Window.partitionBy("q")
    return all_rows.withColumns({"rank": F.row_number().over(by_rank), "compared": F.sum("compared").over(total)}).where(F.col("rank") <= k).select(
        F.col("q").alias("question"), "id", "distance", "rank", "compared")
