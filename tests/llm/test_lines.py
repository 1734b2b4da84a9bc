"""Line dedup against plain dictionaries, and the shards' arrays alone."""

import hashlib
from collections import defaultdict

import numpy as np

from gondola.llm import lines
from gondola.llm import queries as q

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_chars=20, least_docs=3):
    """(id, lines, dropped, what stays) of each row (id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    n, last = defaultdict(int), {}
    for i, own in split:
        for k in {key(x) for x in own}:
            n[k] += 1
            last[k] = max(last.get(k, i), i, key=lambda x: -1 if x is None else x)
    out = []
    for i, own in split:
        kept = [x for x in own if len(key(x)) < least_chars or n[key(x)] < least_docs or last[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in q.op12_line_dedup(spark, SF).collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(docs)}
    assert got == want and sum(x[1] for x in want.values()) > 100


LONG = "this line is long enough to count"
ODD = [
    (1, None), (2, ""), (3, "\n\n"), (4, f"  {LONG.upper()}\r\nshort\n{LONG}"), (5, f"{LONG}\t"), (6, f"own\n\x0b{LONG}"), (7, LONG), (7, LONG),
    (8, "é" * 19), (9, "é" * 19), (10, "é" * 19), (11, "é" * 20), (12, "é" * 20), (13, "x\n" + "é" * 20), (14, "É" * 20), (15, "twice here, twice here\ntwice here, twice here"),
    (16, "twice here, twice here"), (None, "only rows without an id hold it"), (None, "only rows without an id hold it"), (None, "only rows without an id hold it"), (None, LONG),
    (20, "\u00a0" + "no-break space is no white space"), (21, "no-break space is no white space"), (22, "no-break space is no white space"), (23, f"{LONG}\n" * 50_000), (24, "z" * 400_000)]


def run(spark, rows, **params):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, doc string, n_lines int")
    found = lines.deduped(docs, lines.LineParams(**params)).select("doc.doc_id", "n_lines", "n_dropped", "doc.text", "doc.doc", "doc.n_lines").collect()
    assert all(r[4] == "x" and r[5] == 1 for r in found)
    return sorted([tuple(r)[:4] for r in found], key=str)


def test_edges(spark):
    assert run(spark, ODD) == sorted(plain(ODD), key=str)
    assert run(spark, ODD, least_docs=2, least_chars=1) == sorted(plain(ODD, 1, 2), key=str)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short")]) == [(1, 1, 0, ""), (2, 1, 0, "short")]


def test_many_shards(spark):
    """A line that all documents hold, groups of copies, and shards far smaller than the keys."""
    rows = [(i, "\n".join([LONG, f"a line that documents share by sevens {i // 7}", f"a line of document number {i:08d} alone"])) for i in range(3000)]
    assert run(spark, rows, shard_keys=50) == sorted(plain(rows), key=str)


def test_shard():
    rng = np.random.default_rng(5)
    h1, h2 = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))
    h1[-3:] = h1[0]  # equal first halves
    n, last = rng.integers(1, 100, len(h1)), rng.integers(0, 1 << 40, len(h1))
    shard = lines.Shard.read(lines.Shard.build(h1, h2, n, last).data())
    assert sorted(shard.slots(np.unique(h1)).tolist()) == list(range(len(np.unique(h1))))
    count, top = shard.probe(h1, h2)
    assert (count == n).all() and (top == last).all()
    count, _ = shard.probe(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), h2)
    assert not count.any()
    assert not shard.probe(h1, h2 + np.uint64(1))[0].any()
    assert len(shard.bits) * 64 / len(h1) < 5
    empty = lines.Shard.read(lines.Shard.build(h1[:0], h2[:0], n[:0], last[:0]).data())
    assert not empty.probe(h1, h2)[0].any()
