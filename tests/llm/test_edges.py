"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import random
import struct
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gondola.llm import bpe, embed_dedup, iblt, minhash, mixing, quality, shared, sharding, token_files, url_filter, warc
from gondola.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _k long, row_key string, size int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "One two three four five six."), (2, ""), (3, None), (4, "One two three four five six."), (4, "One two three four five six."),
    (5, LONG), (6, "\n\n"), (None, "it's 's ''re  \t x\u00a0y 12 e\u0301 \u4e2d\u6587"), (7, "a b"), (8, "a b"), (9, LONG + " end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 1 else "en", None if i in (2, 7) else "s", 0, "x", 5, "y", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_minhash(docs, empty):
    params = minhash.MinHashParams(shingle=3, percent=85)
    got = [(r["doc_id"], r["n_shingles"], r["component"]) for r in minhash.near_duplicates(docs, params).collect()]
    assert len(got) == len(TEXTS)
    want = {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, None: None, 7: 7, 8: 7, 9: 5}
    assert all(c == want[i] for i, _, c in got)
    assert {n for i, n, _ in got if i in (2, 3, 6)} == {0} and {n for i, n, _ in got if i == 7} == {1}
    kept = minhash.keep_firsts(docs, params)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 6, None, 7]))
    assert minhash.near_duplicates(empty, params).count() == 0


def test_minhash_blocks(spark):
    """A family whose members link in chains: blocks smaller than the family give the same components."""
    rng, rows = random.Random(5), []
    base = [f"t{k}" for k in range(300)]
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(298)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in sets}
    assert 1 < len(set(want.values())) < 60
    for block in (4, 256):
        params = minhash.MinHashParams(shingle=3, percent=85, block=block)
        assert {r["doc_id"]: r["component"] for r in minhash.near_duplicates(df, params).collect()} == want


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows, i = [], 0
    for k in range(240):
        v = base[k % 6] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.15])
        rows.append((i, v.tolist(), k % 2))
        i += 1
    rows += [(i, rows[0][1], 0), (i + 1, None, 0), (i + 2, [0.0] * 16, 0), (i + 3, [float("nan")] * 16, 0), (i + 4, [None] + [1.0] * 15, 0),
             (i + 5, rows[0][1], None), (i + 6, [1.0] * 4, 0), (i + 7, [], 0), (i + 8, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [r for r in rows[:241]]
    m = np.array([r[1] for r in ok])
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = np.array([r[2] for r in ok])
    link = (m @ m.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    reach = np.eye(len(ok), dtype=bool) | link
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for tile in (16, 1024, 16384):
        got = {r["vec_id"]: (r["n_links"], r["component"]) for r in embed_dedup.near_vectors(df, embed_dedup.EmbedParams(tile=tile)).collect()}
        assert len(got) == len(rows)
        for k in range(len(ok)):
            assert got[k] == (link[k].sum(), np.flatnonzero(reach[k])[0])
        assert all(got[k] == (0, k) for k in range(i + 1, i + 9))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    """Lengths that overflow or vanish when squared, repeated ids, copies, clashing names."""
    base = np.array([3.0, -1.0, 2.0, 0.5])
    rows = [(0, base * 1e200, "a"), (1, base * 1e-200, "a"), (2, base * 1.0001, "a"), (2, base * [1, 1, 1, -1], "a"), (3, base * 5e-324, "a"), (4, base * [1, -1, 1, 1], "a"), (4, base * [1, -1, 1, 1], "b")]
    df = spark.createDataFrame([(i, v.tolist(), lab, "x", 1, 2, 0.5) for i, v, lab in rows], "vec_id long, embedding array<double>, label string, cid string, _id int, links int, scale double")
    got = sorted((r["vec_id"], r["n_links"], r["component"]) for r in embed_dedup.near_vectors(df, embed_dedup.EmbedParams(threshold=0.9999)).collect())
    # 5e-324 keeps whole multiples only: [3, -1, 2, 0 or 1]
    assert got[:2] == [(0, 2, 0), (1, 2, 0)] and (2, 2, 0) in got and (2, 0, 2) in got and got[-2:] == [(4, 0, 4), (4, 0, 4)]


def test_bounds_are_rigorous():
    """Sure links are links, and what is neither sure nor open is none; most pairs are decided without full precision."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 96))
    v = embed_dedup.unit(np.concatenate([base[rng.integers(0, 40, 900)] + rng.normal(size=(900, 96)) * rng.choice([0.01, 0.05, 0.14], 900)[:, None], base * 1e-3]))
    form, params = embed_dedup.quantise(v), embed_dedup.EmbedParams(block=128)
    state = np.zeros((len(v), len(v)), int)
    for k, sure, open_ in embed_dedup.screened(form, form, params):
        state[sure[0] + k, sure[1]] = 1
        state[open_[0] + k, open_[1]] = 2
    true = np.array([[x @ y for y in v] for x in v])
    assert (true[state == 1] >= 0.98).all() and (true[state == 0] < 0.98).all()
    assert (state == 1).sum() > 1000 and 0 < (state == 2).sum() < (true > 0.95).sum()
    assert form[0].dtype == np.int8


def test_token_files(spark, docs, empty):
    path, params = q.tokenizer("word_bpe_49k.json"), token_files.TokenFileParams(shard_ids=2000)
    library = token_files.encoder(path, 1000).library
    index = token_files.write_tokens(docs, path, shared.work_path(spark, "t"), params)
    got = token_files.with_starts(index, token_files.read_tokens(index, params)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None]
    texts, start = {i: t for i, t in TEXTS}, 0
    for r in got:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    none = token_files.write_tokens(empty, path, shared.work_path(spark, "t"), params)
    assert token_files.with_starts(none, token_files.read_tokens(none, params)).count() == 0


def test_shard_round_trip():
    rng, params = np.random.default_rng(1), token_files.TokenFileParams(least=4)
    docs = [np.append(rng.choice([1, 1, 1, 2, 2, 7], n), 1).astype(np.uint32) for n in (0, 1, 50, 3000, 5)]
    shard = token_files.Shard(token_files.pack_shard([5, None, 3, 2, 1], docs, 50, params))
    assert shard.doc_ids == [5, None, 3, 2, 1] and len(shard.rules) > 0
    assert all((a == b).all() for a, b in zip(shard.all(), docs))
    assert all((shard.document(k) == docs[k]).all() for k in range(5))
    assert (shard.tokens(3, 700, 1900) == docs[3][700:1900]).all()


def test_sharding(docs, empty):
    got = sharding.byte_shards(docs, 8).collect()
    assert len(got) == len(TEXTS) and sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    # equal texts, null and empty ones too, are one group; its null ids come last
    for ids in ((1, 4), (2, 3), (7, 8)):
        own = sorted((r["slot"], r["doc_id"], r["shard"]) for r in got if r["doc_id"] in ids)
        assert [i for _, i, _ in own] == sorted(i for _, i, _ in own) and len({s for _, _, s in own}) == 1
    assert sharding.byte_shards(empty, 8).count() == 0 and sharding.byte_shards(docs, 1).where("shard = 0").count() == len(TEXTS)


def test_sharding_cuts_only_groups_that_must_be(spark):
    rows = [(i if i % 7 else None, "hot " * 20) for i in range(120)] + [(1000 + i, f"t{i // 3} " * 9) for i in range(90)]
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r["text_md5"], []).append(r)
    hot = max(by.values(), key=len)
    assert len(hot) == 120 and len({r["shard"] for r in hot}) >= 3
    assert all(len({r["shard"] for r in x}) == 1 for x in by.values() if x is not hot)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(4)]
    assert all(abs(x - total / 4) <= max(sum(r["size"] for r in x) for x in by.values() if x is not hot) + 81 for x in sizes)
    ordered = [r["doc_id"] for r in sorted(hot, key=lambda r: (r["shard"], r["slot"]))]
    known = [i for i in ordered if i is not None]
    assert known == sorted(known) and ordered[len(known):] == [None] * (120 - len(known))


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = quality.train(docs, some)
        scores = [r[0] for r in docs.select(quality.scored(model, docs.text)).collect()]
        assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    assert empty.select(quality.scored(model, empty.text)).count() == 0


def test_quality_against_plain_descent(spark):
    """The classifier against the same steps written plainly: log-count ratios, unit vectors, dual coordinate descent."""
    rng = random.Random(4)
    good, bad = [f"good{k}" for k in range(30)], [f"bad{k}" for k in range(30)]
    texts = [" ".join(rng.choice((good if y else bad) + ["x", "y", "z"]) for _ in range(rng.randrange(4, 40))) for y in (k % 3 != 0 for k in range(90))]
    labels, params = np.array([int(k % 3 != 0) for k in range(90)]), quality.QualityParams(dims=1 << 12)
    cells = quality.features(pa.array(texts), params.dims)
    model = quality.fit(cells, labels, params)
    train = [k for k in range(90) if k % params.held]
    n = {y: [sum(c in set(cells[k].tolist()) for k in train if labels[k] == y) for c in range(params.dims)] for y in (0, 1)}
    docs_of = {y: sum(labels[k] == y for k in train) for y in (0, 1)}
    ratio = [np.log(((n[1][c] + 1) / (docs_of[1] + 2)) / ((n[0][c] + 1) / (docs_of[0] + 2))) if n[0][c] + n[1][c] > 1 else 0.0 for c in range(params.dims)]
    rows = {k: {int(c): ratio[c] for c in cells[k]} for k in range(90)}
    rows = {k: {c: v / max(np.sqrt(sum(x * x for x in r.values())), 1e-9) for c, v in r.items()} for k, r in rows.items()}
    w, bias, alpha, order = dict.fromkeys(range(params.dims), 0.0), 0.0, [0.0] * len(train), np.random.default_rng(11)
    for _ in range(params.epochs):
        moved = 0.0
        for t in order.permutation(len(train)):
            k = train[t]
            y = 1.0 if labels[k] else -1.0
            top = params.cost if labels[k] else params.cost * docs_of[1] / docs_of[0]
            gradient = y * (sum(w[c] * v for c, v in rows[k].items()) + bias) - 1
            new = min(max(alpha[t] - gradient / (1 + sum(v * v for v in rows[k].values())), 0.0), top)
            for c, v in rows[k].items():
                w[c] += (new - alpha[t]) * y * v
            bias += (new - alpha[t]) * y
            moved, alpha[t] = max(moved, abs(new - alpha[t])), new
        if moved < 1e-3:
            break
    margin = lambda k: sum(w[c] * v for c, v in rows[k].items()) + bias
    want = [1 / (1 + np.exp(-(model.slope * margin(k) + model.shift))) for k in range(90)]
    assert model.scores(cells) == pytest.approx(want, abs=1e-5)
    assert np.mean([(s >= 0.5) == y for s, y in zip(want, labels)]) > 0.95


def test_quality_takes_bounded_cells(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 10)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.QualityParams(fit_cells=0))
    assert not model.weights.any()


def test_mixing(docs, empty):
    report = mixing.mixed_report(docs).collect()
    assert len(report) == len(TEXTS)
    target = {r["source"]: r["target"] for r in report}
    for s in target:
        assert abs(sum(r["taken"] for r in report if r["source"] == s) - target[s]) <= 1
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for s in target:
        words = sum(len((r["text"] or "").split()) for r in rows.collect() if r["source"] == s)
        assert abs(words - sum(r["taken"] for r in report if r["source"] == s)) <= max(r["size"] for r in report if r["source"] == s) / 2
    assert all(r["text"] == texts[r["doc_id"]] for r in rows.collect())
    assert mixing.mixed_report(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_fingerprints(docs, empty):
    got = iblt.fingerprints(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    three = next(r for r in got if r["doc_id"] == 3)
    assert three["n_chars"] == 0 and three["near_edited"] == 1 and three["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert iblt.fingerprints(empty).count() == 0


def test_fingerprints_of_copies(spark):
    """Equal rows, many of one id, null ids: each has the next row in the order as its next document."""
    rows = [(1, "a\nb")] * 5 + [(1, "c\nd")] + [(None, f"n{i % 3}\nm") for i in range(6)] + [(7, "a\nb\nq")]
    got = iblt.fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, m string")).collect()
    sets = lambda t: set(t.split("\n"))
    assert len(got) == len(rows) and len({r["fingerprint"] for r in got}) == 6
    ones = sorted(r["near_next"] for r in got if r["doc_id"] == 1)
    # four of five equal rows are followed by an equal one; the fifth and the row c d by each other or by a null id
    assert ones.count(1.0) == 4 and len(ones) == 6
    seven = next(r for r in got if r["doc_id"] == 7)
    assert seven["near_next"] in (len(sets("a\nb") & sets("a\nb\nq")) / 3, 0.0)
    alone = iblt.fingerprints(spark.createDataFrame([(None, "p\nq r s")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 7


def test_fingerprints_of_many_lines(spark):
    """A text of 50,000 lines, edited to the next one's: the work grows with the lines, not with their square."""
    text = lambda tag, n: "\n".join(f"{tag} line {k}" for k in range(n))
    took = {}
    for n in (8_000, 16_000, 50_000):
        docs = spark.createDataFrame([(1, text("a", n)), (2, text("a", n // 2) + "\n" + text("b", n // 2))], "doc_id long, text string")
        for _ in range(2 if n < 50_000 else 1):
            start = time.time()
            got = {r["doc_id"]: r for r in iblt.fingerprints(docs).collect()}
            took[n] = min(time.time() - start, took.get(n, 1e9))
        assert got[1]["near_next"] == got[2]["near_next"] == pytest.approx((n // 2) / (n + n // 2))
    assert took[16_000] < 2.5 * took[8_000] and took[50_000] < 9 * took[8_000]


def test_url_filter_of_long_hosts(tmp_path):
    """A host of a million labels costs no more than its own characters; suffixes no longer than a rule's host are tried."""
    rules = [url_filter.Rule("block", "example.org", "/x"), url_filter.Rule("allow", "a.a.example.org", "/x/y"), url_filter.Rule("block", "org", "")]
    (tmp_path / "rules").write_bytes(url_filter.pack(rules))
    held = url_filter.RuleFile(str(tmp_path / "rules"))
    tracemalloc.start()
    found = url_filter.judged(["http://" + "a." * 1_000_000 + "example.org/x/y", "http://" + "b." * 1_000_000 + "org", "http://" + "c" * 2_000_000 + "/x"], held, "allow")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[2:] for x in found] == [("a.a.example.org/x/y", "allow"), ("org", "block"), (None, "allow")] and peak < 200 << 20
    for host in ("", ".", "a..b.", "x.example.org", "example.org", ".org"):
        parents, rest = [], host
        while rest:
            parents.append(rest)
            rest = rest.partition(".")[2]
        assert list(url_filter.suffixes(host, 11)) == [p for p in parents if len(p) <= 11]


def _hash(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def _chain(d: int, n: bytes) -> int:
    return _hash(n, _hash(struct.pack("<q", d)) & (1 << 64) - 1)


def test_cells_equal_a_plain_sketch(spark):
    text = "one\ntwo\n\nthree\ntwo\n\u4e2d x"
    got = iblt.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fingerprint"]
    cells = [[0, 0, 0] for _ in range(24)]
    hashes = {_hash(x.encode()) for x in text.split("\n") if x.strip()}
    for d in hashes:
        for g in range(3):
            cell = cells[8 * g + _chain(d, struct.pack("<q", g)) % 8]
            cell[0] += 1
            cell[1] ^= d
            cell[2] ^= _chain(d, struct.pack("<i", 77))
    low = lambda x: format(x & (1 << 64) - 1, "x")
    assert got == f"{len(hashes)}/" + ",".join(f"{c}:{low(k)}:{low(h)}" for c, k, h in cells)


@pytest.mark.parametrize("times", iblt.SketchParams().tries)
def test_each_try_alone(spark, times):
    """A try gives the true difference or nothing, never another number; larger ones fail less."""
    rng = random.Random(times)
    rows = []
    for _ in range(60):
        both = [rng.getrandbits(63) for _ in range(rng.randrange(200))]
        a, b = ([rng.getrandbits(63) for _ in range(rng.randrange(150))] for _ in range(2))
        rows.append((both + a, b + both, len(a) + len(b)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d int")
    got = df.select("d", F.expr(iblt.larger("a", "b", times, 1000 * times, iblt.SketchParams())).alias("found")).collect()
    assert all(r["found"] in (None, r["d"]) for r in got)
    assert sum(r["found"] is None for r in got) <= (6 if times == 1 else 1)


def test_fingerprints_retry_larger(spark):
    texts = ["\n".join(f"line {k} of {i % 2}" if k % 3 else f"line {k}" for k in range(400)) for i in range(3)]
    got = {r["doc_id"]: r for r in iblt.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    a, b = (set(t.split("\n")) for t in texts[:2])
    assert got[1]["near_next"] == pytest.approx(len(a & b) / len(a | b))


def test_byte_bpe(docs, empty):
    path = q.tokenizer("byte_bpe_50k.tiktoken")
    got = docs.select("text", bpe.encoded(path, docs.text).alias("x")).collect()
    for r in got:
        assert r["x"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    pairs = bpe.vocabulary(path)
    assert all(pairs.encode([t or ""])[0].tolist() == pairs.plain(t or "") for _, t in TEXTS[:8])
    assert empty.select(bpe.encoded(path, empty.text)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000, np.uint64)
    found = bpe.PerfectHash(keys).index(keys)
    assert sorted(found) == list(range(5000))


def test_url_filter_long_and_repeated(spark):
    long = "http://" + "a." * 3000 + "com/fr/" + "x" * 1_000_000
    df = spark.createDataFrame([(1, long), (1, long), (None, "http://com/de/")], "page_id long, url string")
    got = df.select(url_filter.verdicts(spark, df.url, q.URL_RULES).alias("v")).collect()
    assert sorted((r["v"]["rule"], r["v"]["verdict"], len(r["v"]["path"])) for r in got) == [("com/de/", "block", 4), ("com/fr/", "allow", 1_000_004), ("com/fr/", "allow", 1_000_004)]


def test_url_filter(spark, tmp_path):
    urls = [None, "", "x", "http://", "HTTP://Sub.Example.ORG/es/1?x#y", "http://example.org?/es/", "https://org/", "http://notorg/", "a://b://c.com/de/", "http://x.com/fr/#"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [r["v"] for r in df.orderBy("page_id").select(url_filter.verdicts(spark, df.url, q.URL_RULES).alias("v")).collect()]
    assert [tuple(r) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("sub.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("org", "/", "org/", "allow"),
        ("notorg", "/", None, "allow"), ("b:", "//c.com/de/", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow")]
    assert df.limit(0).select(url_filter.verdicts(spark, df.url, []).alias("v")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (None, "http://b/\r\nc", "x"), (4, "u", None), (5, "u", ""), (2, "u", "y" * 3_000_000), (2, None, "x")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, body string")
    index = warc.write_archives(pages, shared.work_path(spark, "w"))
    got = sorted(map(str, ((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_report(warc.read_records(index)).collect())))
    assert got == sorted(map(str, [
        (1, 1, "response", None), (2, 1, "revisit", 1), (2, 1, "revisit", 1), (None, 1, "revisit", 1), (4, 0, "response", None),
        (5, 0, "revisit", 4), (2, 3_000_000, "response", None)]))
    one = warc.read_records(index.where("page_id = 1")).collect()
    assert [(r["url"], bytes(r["payload"])) for r in one] == [("http://a/", b"x")]
    none = warc.write_archives(pages.limit(0), shared.work_path(spark, "w"))
    assert warc.page_report(warc.read_records(none)).count() == 0
