"""Fill-in-the-middle against plain string cutting, and the rope alone."""

import hashlib
import random
import re

import pytest

from gondola.llm import fim
from gondola.llm import queries as q

SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    """(n, form, prefix, middle, output) by slices of a list of units."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = q.op11_fill_in_middle(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        n, form, p, m, out = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb"), (7, "a\nb\n"), (8, "has <S> inside\nx"), (9, "<P"), (10, "x<\n<S\n>\n<M"),
    (11, "é\u2028ü\r\n\x0bß\n" * 3), (12, "same\ntext"), (12, "same\ntext"), (None, "no id\nat all\n"), (13, "😀\n" * 20_000), (14, "z" * 300_000), (15, "ab\n" * 100_000 + "end")]


def test_edges(spark):
    rows = spark.createDataFrame([(i, t, "x", 5) for i, t in ODD], "doc_id long, text string, output string, n int")
    found = fim.transformed(rows)
    out = found.select("*", fim.restored(found["output"], found["form"]).alias("back")).collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t in ODD), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out), key=str) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transformed(rows.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["line", "char"])
def test_params(spark, unit):
    """Rates, other units and sentinels; the round trip holds for all."""
    params = fim.FimParams(unit=unit, rate=60, spm_rate=30, seed=3, prefix="«pre»", suffix="«suf»", middle="«mid»", leaf=3)
    texts = [(i, "".join(random.Random(i).choices("ab\ncé", k=i % 40))) for i in range(400)]
    found = fim.transformed(spark.createDataFrame(texts, "doc_id long, text string"), params)
    rows = found.select("*", fim.restored(found["output"], found["form"], params).alias("back")).collect()
    assert {r.doc_id: r.back for r in rows} == dict(texts)
    forms = [r.form for r in rows if dict(texts)[r.doc_id]]
    assert 0.5 < 1 - forms.count("plain") / len(forms) < 0.7 and 0.2 < forms.count("spm") / (len(forms) - forms.count("plain")) < 0.4
    if unit == "char":
        assert all(r.n == len(dict(texts)[r.doc_id]) for r in rows)


def test_rope():
    """Splits at every rank, of both kinds; caches agree with the leaves; depth grows with the logarithm."""
    text = "ab\n\ncdé\nf" * 3
    tree = fim.rope(text, "\n", 2)
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    for k in range(text.count("\n") + 1):
        a, b = fim.split(tree, k, "\n")
        assert ["".join(fim.leaves(x)) for x in (a, b)] == ["".join(lines[:k]), "".join(lines[k:])]
        assert (a.ends, a.chars) == (k, len("".join(lines[:k])))
    for k in range(len(text) + 1):
        a, b = fim.split(tree, k, "\n", chars=True)
        assert "".join(fim.leaves(a)) == text[:k] and b.chars == len(text) - k

    def depth(x):
        return 0 if x.left is None else 1 + max(depth(x.left), depth(x.right))

    assert depth(fim.rope("x" * 100_000, "\n", 10)) <= 14
