"""Nearest vectors of many questions against brute force; retrieval's plan."""

import numpy as np
import pytest

from gondola.operators.vectors import NearParams, nearest, rounded
from gondola.plans import corpus

SF = "/root/testdata/sf0.01"


def brute(rows, questions, k):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], float)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    out = {}
    for q, v in questions:
        v = np.array(v, float)
        d = rounded(1 - m @ (v / np.sqrt(v @ v)), 6)
        out[q] = sorted(zip(d.tolist(), ids))[:k]
    return out


@pytest.mark.parametrize("k,params", [(5, NearParams()), (7, NearParams(centres=16, tile=64, questions=10)), (1, NearParams(centres=1)), (400, NearParams(centres=40, tile=100))])
def test_thousand_questions(spark, k, params):
    """1,000 questions over groups of near vectors, ties among copies: equal to brute force, by a part of the pairs."""
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(30, 12))
    m = (heart[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 12))).round(4)
    m[:300] = m[300]
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)]
    asked = rows[::3] if k < 100 else rows[:60]
    base = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = {}
    compared = 0
    for r in nearest(base, spark.createDataFrame(asked, "id long, v array<double>"), k, "id", "v", params).collect():
        got.setdefault(r.question, []).append((r["rank"], r.distance, r.id))
        compared += r.compared if r["rank"] == 1 else 0
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows, asked, k)
    if k == 5:
        assert compared < 0.35 * len(rows) * len(asked)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (8, [2.0, 0.0]), (9, [])]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    got = sorted(tuple(r)[:3] for r in nearest(base, base, 9, "id", "v").collect())
    assert got == sorted((q, i, 0.0 if (q == 7) == (i == 7) else 2.0) for q in (1, 7, 8) for i in (1, 7, 8))
    assert nearest(base.limit(0), base, 3, "id", "v").count() == 0 and nearest(base, base.limit(0), 3, "id", "v").count() == 0


def test_texts_are_fetched_after_the_ranking(spark):
    """One evaluation of the distance, and no text below the top k."""
    plan = corpus.search_external_context(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    lines = plan.split("\n")
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    top = next(k for k, x in enumerate(lines) if "TakeOrdered" in x and "distance" in x and "ArrowEvalPython" in "".join(lines[k:]))
    top = max(k for k, x in enumerate(lines) if "TakeOrdered" in x and k >= top)
    below = [x for x in lines[top + 1 :] if deep(x) > deep(lines[top])]
    assert any("FileScan" in x for x in below) and not any("text#" in x for x in below)
