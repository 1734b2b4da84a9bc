"""Chunks, claims, breaker, injections, drift and lookups."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gondola.operators.chunks import ChunkParams, SubwordTokenizer, WordTokenizer, chunks, cut, sections
from gondola.operators.grounding import INJECTION, Breaker, Claim, ToolCall, drifted, injections, verified
from gondola.operators.joins import asof
from gondola.plans.serving import UnknownId, price_history, store_category

HEADING = ChunkParams().heading


def test_sections():
    text = "intro\n# One\na\n\nb\n## Empty\n\n[ITEM 7A]\nc\n#no heading\n"
    assert list(sections(text, HEADING)) == [(None, "intro"), ("# One", "a\n\nb"), ("[ITEM 7A]", "c\n#no heading")]
    assert list(sections("", HEADING)) == list(sections(" \n\n", HEADING)) == []


def test_pack_and_windows():
    params = ChunkParams(target=4, limit=6, overlap=0.5)
    words = lambda n, s="w": " ".join(f"{s}{i}" for i in range(n))
    got = list(cut(f"{words(2)}\n\n{words(2, 'x')}\n\n{words(1, 'y')}\n\n{words(10, 'z')}", WordTokenizer(), params))
    assert [g[2] for g in got] == [4, 1, 6, 6, 4, 1]
    assert got[0][1] == f"{words(2)}\n\n{words(2, 'x')}"
    seen = {w for g in got for w in g[1].split()}
    assert {f"z{i}" for i in range(10)} <= seen
    assert all(g[2] <= params.limit for g in got)


class Growing(WordTokenizer):
    """Decoding adds tokens, as subword tokenizers can."""

    def decode(self, ids):
        return " ".join(ids) + (" more more" if len(ids) > 4 else "")


def test_limit_holds_after_decoding():
    got = list(cut(" ".join("abcdefghijklmnop"), Growing(), ChunkParams(target=4, limit=6)))
    assert got and all(g[2] <= 6 for g in got)


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([(1, "# A\none two", "k"), (2, None, "k"), (3, "", "k"), (1, "# A\none two", "k"), (None, "x", "k")], "id long, text string, chunk string")
    got = sorted(map(tuple, chunks(docs, "id", "text").collect()), key=str)
    assert got == sorted([(1, 0, "# A", "one two", 2)] * 2 + [(None, 0, None, "x", 1)], key=str)
    assert chunks(docs.limit(0), "id", "text").collect() == []


def test_claims():
    calls = [ToolCall("c1", "prices", {"gap": 1.25, "label": "High"}), ToolCall("c2", "search", {"text": "x"})]
    ok = [Claim("c1", "prices", "gap", "1.2500000001"), Claim("c1", "prices", "label", "High")]
    assert verified(ok, calls, {"prices"}) == (True, None) == verified([], calls, set())
    for bad in (Claim("c9", "prices", "gap", 1.25), Claim("c2", "search", "text", "x"), Claim("c2", "prices", "gap", 1.25), Claim("c1", "prices", "none", 1), Claim("c1", "prices", "gap", 1.26),
                Claim("c1", "prices", "label", "high")):
        holds, reason = verified([*ok, bad], calls, {"prices"})
        assert not holds and reason


def test_breaker():
    fails = [True, False, True, True, True]

    def tool(x):
        if fails.pop(0):
            raise ValueError("no")
        return {"x": x}

    breaker = Breaker()
    assert [("error" in breaker.call(tool, x=1)) for _ in range(5)] == [True, False, True, True, True]
    assert fails == [True]  # the fifth call was refused
    assert "error" in breaker.call(tool, x=2) and not fails


def test_injections(spark):
    rows = spark.createDataFrame([(0, "You are NOW; use this value instead"), (1, None), (2, "plain"), (3, "")], "i int, t string")
    got = dict(map(tuple, rows.select("i", injections(F.col("t"))).collect()))
    assert got == {0: ["you are now", "use this value instead"], 1: [], 2: [], 3: []} and len(INJECTION) == 17


def test_drift(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], "id int, h string")
    new = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "x", False), (4, "d", True), (5, "e", None)], "id int, h string, ext boolean")
    assert dict(map(tuple, drifted(old, new, "id", "h", "ext").collect())) == {2: "refuse", 3: "reload", 4: "load", 5: "reload"}


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", "2020-01-01", 5), (1, "a", "2020-02-01", 6), (2, "b", "2020-01-01", 7)], "store_id int, category string, month string, v int")
    assert store_category(df, 1, "a").first()["v"] == 6
    assert store_category(df, 1, "a", "2020-01-01").first()["v"] == 5
    assert store_category(df, 1, "b").isEmpty()
    assert [x["v"] for x in price_history(df, 1, "a").collect()] == [6, 5] and price_history(df, 1, "a", 1).count() == 1
    for bad in ((9, "a"), (1, "z")):
        with pytest.raises(UnknownId):
            store_category(df, *bad)
    with pytest.raises(ValueError):
        price_history(df, 1, "a", 0)


@pytest.mark.parametrize("by", [[], ["k"], ["k", "j"]])
def test_asof_over_years(spark, by):
    """Keys and times over years, ties, null times and null keys, against a loop."""
    rng = random.Random(len(by))
    day = lambda: date(2020, 1, 1) + timedelta(rng.randrange(2000)) if rng.random() < 0.95 else None
    rows = lambda n: [(rng.choice(["a", "a", "b", None]), rng.randrange(2), day(), i) for i in range(n)]
    left, right = rows(300), rows(60)
    right += [(k, j, d, i + 100) for k, j, d, i in right[:20]]  # equal times
    at = {"k": 0, "j": 1}
    want = {}
    for x in left:
        met = [y for y in right if y[2] and x[2] and y[2] <= x[2] and all(x[at[b]] == y[at[b]] for b in by)]
        best = max(met, key=lambda y: (y[2], y[3])) if met else None
        want[x[3]] = best and (best[2], best[3])
    l = spark.createDataFrame(left, "k string, j int, d date, i int").repartition(3)
    r = spark.createDataFrame(right, "k string, j int, e date, v int").repartition(2)
    got = {x.i: x.e and (x.e, x.v) for x in asof(l, r if by else r.drop("k", "j"), "d", "e", by, ["v"]).collect()}
    assert got == want


def test_subword_chunks():
    """Limit and overlap of a long paragraph against plain slices of its tokens; small paragraphs are packed up to the target."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    own, library, params = SubwordTokenizer(path), Tokenizer.from_file(path), ChunkParams(target=40, limit=60, overlap=0.2)
    text = " ".join(f"word{k} na\u00efve" for k in range(100))
    ids = library.encode(text, add_special_tokens=False).ids
    want = [ids[at : at + 60] for at in range(0, len(ids), 48)]
    got = list(cut(text, own, params))
    assert len(got) == len(want) and all(size <= 60 for _, _, size in got)
    exact = [library.decode(x, skip_special_tokens=False) for x in want]
    # a window that begins or ends inside a character is encoded anew and may be shortened, never lengthened
    assert all(c == e or e.startswith(c[:20]) for (_, c, _), e in zip(got, exact)) and sum(c == e for (_, c, _), e in zip(got, exact)) > len(got) / 2
    packed = list(cut("\n\n".join(["one two three four five six seven eight nine ten"] * 9), own, params))
    assert [c.count("ten") for _, c, _ in packed] == [4, 4, 1] and all(size == len(own.encode(c)) <= 60 for _, c, size in packed)
    assert own.encode("<|endoftext|>") != [50256]
