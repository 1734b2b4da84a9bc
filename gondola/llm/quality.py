"""Quality classifier: naive Bayes log-count ratios inside a linear support vector machine.

Features are indicators of n-grams, hashed to `dims` cells: words, and runs of one
to three word shapes (case, digits, signs at the end, repetition of the word
before).  Indicator j counts
r_j, the log ratio of its smoothed rates in the two classes.  On the scaled
indicators (each text's vector brought to unit length) dual coordinate descent
fits the hinge loss; a logistic curve, fitted on rows that the descent did not
see, turns margins into scores.

The fit takes the labelled rows of smallest hash, at most `fit_rows` of them and at
most `fit_cells` cells: bounds on what reaches the driver that do not grow with the
data (4 bytes a cell).  Scoring takes whole texts, all rows.

Defined results: null and empty texts have no features and score by the intercept
alone.  Labels that are null do not take part; where labels hold one class only or
none, every score is that class's share (0.5 without labels).  Rows of labels
that repeat an id count once, with their smallest label.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm import shared
from gondola.llm.words import SPACE, Words, mix, passes


@dataclass(frozen=True)
class QualityParams:
    dims: int = 1 << 18
    fit_rows: int = 6000  #: bound on labelled rows that the fit takes
    fit_cells: int = 1 << 25  #: bound on cells of those rows, all together
    smooth: float = 1.0
    cost: float = 1.0  #: C of the hinge loss
    epochs: int = 12
    held: int = 4  #: one in so many fit rows is kept for the logistic curve
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  #: one a cell: ratio times machine weight
    squares: np.ndarray  #: one a cell: ratio squared, for the length of a text's vector
    bias: float
    slope: float
    shift: float

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.bias + self.weights[c].sum() / max(np.sqrt(self.squares[c].sum()), 1e-9) for c in cells])
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def features(texts: pa.Array, dims: int) -> list[np.ndarray]:
    """For each text the distinct cells of its n-grams."""
    upper, lower, digit = (np.zeros(256, np.int64) for _ in range(3))
    upper[65:91] = lower[97:123] = digit[48:58] = 1
    high = np.zeros(256, np.int64)
    high[128:] = 1
    out = []
    for group in passes(texts):
        w = Words(group)
        n = len(w.starts)
        if not n:
            out += [np.zeros(0, np.int64) for _ in group]
            continue
        raw = w.raw
        sums = [np.concatenate([[0], np.cumsum(t[raw])]) for t in (upper, lower, digit, high, ~SPACE * 1)]
        up, low, dig, hi, size = (s[w.ends] - s[w.starts] for s in sums)
        sign = size - up - low - dig - hi
        case = np.where(up == 0, 0, np.where(low > 0, 1, np.where(up == 1, 2, 3)))
        tail = raw[w.ends - 1]
        ends_plain = (upper[tail] + lower[tail] + digit[tail] + high[tail]) > 0
        same = np.zeros(n, np.int64)
        same[1:] = w.hashes[1:] == w.hashes[:-1]
        same[w.bounds[:-1][w.bounds[:-1] < n]] = 0
        long = np.digitize(size, (2, 14, 24))
        shape = case + 4 * np.minimum(sign, 3) + 16 * (dig > 0) + 32 * same + 64 * long + 256 * np.where(ends_plain, 0, tail.astype(np.int64))
        grams = [mix(w.hashes + np.uint64(1))]
        s = shape.astype(np.uint64)
        one = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2))
        two, three = one.copy(), one.copy()
        two[:-1] = mix(one[:-1] * np.uint64(3) + one[1:])
        three[:-2] = mix(two[:-2] * np.uint64(5) + one[2:]) if n > 2 else three[:-2]
        grams += [one, two, three]
        cells = [(g % np.uint64(dims)).astype(np.int64) for g in grams]
        b = w.bounds
        for k in range(len(group)):
            a, e = b[k], b[k + 1]
            parts = [cells[0][a:e], cells[1][a:e], cells[2][a : max(e - 1, a)], cells[3][a : max(e - 2, a)]]
            out.append(np.unique(np.concatenate(parts)))
    return out


def fit(cells: list[np.ndarray], labels: np.ndarray, params: QualityParams) -> Model:
    """The model of the rows with these cells and labels (0 or 1), in a fixed order."""
    dims, n = params.dims, len(cells)
    share = float(np.clip(labels.mean(), 0.001, 0.999)) if n else 0.5
    flat = np.zeros(dims)
    if n < 2 * params.held or labels.min() == labels.max():
        return Model(flat, flat, 0.0, 0.0, float(np.log(share / (1 - share))))
    train = [k for k in range(n) if k % params.held]
    held = [k for k in range(n) if k % params.held == 0]
    counts = np.full((2, dims), params.smooth)
    rows = np.zeros(2)
    for k in train:
        counts[labels[k], cells[k]] += 1
        rows[labels[k]] += 1
    rate = counts / (rows[:, None] + 2 * params.smooth)
    ratio = np.log(rate[1] / rate[0])
    ratio[(counts[0] + counts[1]) <= 2 * params.smooth + 1] = 0  # seen once: no evidence
    squares = ratio**2
    # dual coordinate descent, hinge loss; the last weight is the intercept
    values = [ratio[cells[k]] / max(np.sqrt(squares[cells[k]].sum()), 1e-9) for k in train]
    y = np.where(labels[train] == 1, 1.0, -1.0)
    cap = np.where(y > 0, params.cost, params.cost * rows[1] / max(rows[0], 1))  # both classes weigh the same
    norms = np.array([1 + (v @ v) for v in values])
    alpha, weights, bias = np.zeros(len(train)), np.zeros(dims), 0.0
    rng = np.random.default_rng(11)
    for _ in range(params.epochs):
        moved = 0.0
        for t in rng.permutation(len(train)):
            c, v = cells[train[t]], values[t]
            slope = y[t] * (weights[c] @ v + bias) - 1
            new = min(max(alpha[t] - slope / norms[t], 0.0), cap[t])
            step = new - alpha[t]
            if step:
                alpha[t] = new
                weights[c] += step * y[t] * v
                bias += step * y[t]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Model(weights * ratio, squares, bias, 1.0, 0.0)
    margin = np.array([model.bias + model.weights[cells[k]].sum() / max(np.sqrt(squares[cells[k]].sum()), 1e-9) for k in held])
    slope, shift = logistic(margin, labels[held])
    return Model(model.weights.astype(np.float32), squares.astype(np.float32), bias, slope, shift)


def logistic(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """slope and shift of the logistic curve through (x, label), by damped Newton steps; smoothed targets."""
    pos, neg = max(label.sum(), 1), max((1 - label).sum(), 1)
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - t
        h = np.array([[w @ (x * x) + 1e-6, w @ x], [w @ x, w.sum() + 1e-6]])
        step = np.linalg.solve(h, [g @ x, g.sum()])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled rows that are not held out, at most params.fit_rows of them."""
    shared.bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label")).withColumn("_h", F.xxhash64("_id"))
    # fit_rows rows at most: fixed by a parameter, not by the data
    few = shared.stored(picked.orderBy("_h", "_id").limit(params.fit_rows), "quality-sample")

    @F.arrow_udf("array<int>")
    def cells(texts: pa.Array) -> pa.Array:
        return pa.array([c.astype(np.int32) for c in features(texts, params.dims)], pa.list_(pa.int32()))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id")
    found = rows.groupBy("_id", "_h", "label").agg(F.min("text").alias("text")).select("_h", "_id", "label", cells("text").alias("cells"))
    # at most fit_rows rows in this window
    run = Window.orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = shared.stored(found, "quality-cells").withColumn("_sum", F.sum(F.size("cells").cast("long")).over(run)).where(F.col("_sum") <= params.fit_cells)
    got = kept.drop("_sum").toArrow()
    order = np.lexsort((got["_id"].to_numpy(), got["_h"].to_numpy())) if len(got) else []
    return fit([np.asarray(got["cells"][int(k)].values) for k in order], got["label"].to_numpy()[order] if len(got) else np.zeros(0, int), params)


def scored(model: Model, text: Column, params: QualityParams = QualityParams()) -> Column:
    """Score of a text column, 0 to 1; higher: good quality likelier."""
    weights, squares = model.weights, model.squares
    rest = (model.bias, model.slope, model.shift)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(weights, squares, *rest).scores(features(texts, params.dims)), pa.float64())

    return score(text)
