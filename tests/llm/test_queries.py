"""The queries over whole tables, against brute force that shares no code with the operators."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from gondola.llm import queries as q

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(name):
    got = duckdb.sql(f"select * from '{SF}/{name}.parquet'")
    return [dict(zip(got.columns, r)) for r in got.fetchall()]


@pytest.fixture(scope="module")
def docs():
    return sorted(rows("documents"), key=lambda r: r["doc_id"])


def run(spark, name, key="doc_id"):
    got = [r.asDict() for r in q.queries()[name](spark, SF).collect()]
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_warc(spark):
    pages, got = rows("pages"), run(spark, "op1_warc", "page_id")
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        body = (p["html"] or "").encode()
        want = first.setdefault(body, p["page_id"])
        r = got[p["page_id"]]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == p["page_id"] else ("revisit", want))
    assert len(got) == len(pages)


def test_embedding_dedup(spark):
    vectors, got = rows("embeddings"), run(spark, "op2_embedding_dedup", "vec_id")
    by = defaultdict(list)
    for v in vectors:
        by[v["label"]].append(v)
    links = []
    for group in by.values():
        m = np.array([v["embedding"] for v in group], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        links += [(group[i]["vec_id"], group[j]["vec_id"]) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1)))]
    root = roots([v["vec_id"] for v in vectors], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for v in vectors:
        r = got[v["vec_id"]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[v["vec_id"]], root[v["vec_id"]], root[v["vec_id"]] == v["vec_id"])


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.tokenizer("word_bpe_49k.json"))
    got, start = run(spark, "op3_token_files"), 0
    for d in docs:
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def shingles(text, n):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def near_links(sets, percent):
    where, links = defaultdict(list), set()
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    common = defaultdict(int)
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links.add((a, b))
    return links


def test_minhash(spark, docs):
    sets = {d["doc_id"]: shingles(d["text"], 3) for d in docs}
    root, got = roots(sets, near_links(sets, 85)), run(spark, "op4_minhash")
    for k, s in sets.items():
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(s), root[k], root[k] == k)
    assert len(set(root.values())) < len(root)


def test_sharding(spark, docs):
    """Shards are near equal, gapless, and keep each group of equal texts that is no larger than a shard's part."""
    got = run(spark, "op5_sharding")
    by, groups = defaultdict(list), defaultdict(list)
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r["shard"]].append(r)
        groups[raw].append(r)
    assert sorted(by) == list(range(8))
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    total, most = sum(r["size"] for x in by.values() for r in x), 0
    for x in groups.values():
        size = sum(r["size"] for r in x)
        if size <= total // 8:
            assert len({r["shard"] for r in x}) == 1
            most = max(most, size)
    assert sum(len(x) > 1 for x in groups.values()) > 20
    assert all(abs(sum(r["size"] for r in x) - total / 8) <= most for x in by.values())
    # by hand: in the order of digests, every target's cut at the nearer edge of its group
    order = sorted(groups.items(), key=lambda g: hashlib.md5(g[0]).hexdigest())
    ends = np.cumsum([0, *(sum(r["size"] for r in x) for _, x in order)])
    cuts = []
    for target in (total * k // 8 for k in range(1, 8)):
        k = np.searchsorted(ends, target, "right") - 1
        cuts.append(ends[k] if 2 * target < ends[k] + ends[k + 1] else ends[k + 1])
    for (_, x), start in zip(order, ends):
        assert all(r["shard"] == sum(c <= start for c in cuts) for r in x)


def test_quality(spark, docs):
    got, labels = run(spark, "op6_quality"), {r["doc_id"]: r["quality"] for r in rows("labels")}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[k]["predicted"], y) for k, y in labels.items() if got[k]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95
    again = run(spark, "op6_quality")
    assert all(abs(again[k]["score"] - got[k]["score"]) < 1e-12 for k in got)


def targets(size, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    got, free, left = {}, set(names), share * sum(size.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * size[s]]
        if not over:
            got |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            got[s] = most * size[s]
        left -= sum(got[s] for s in over)
        free -= set(over)
    return got


def test_mixing(spark, docs):
    got = run(spark, "op7_mixing")
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(WORD.findall((d["text"] or "").encode()))
    want, taken = targets(size), defaultdict(int)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == len(WORD.findall((d["text"] or "").encode())) and r["source_size"] == size[d["source"]]
        assert abs(r["target"] - want[d["source"]]) < 1e-6 * want[d["source"]] + 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    for s in want:
        # by hand: passes over the source in the order of digests, whole ones and a last one up to the target
        own = sorted((d for d in docs if d["source"] == s), key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest())
        tilt = dict(zip(sorted(want, key=lambda x: (x is None, (x or "").encode())), (0.5, 0.0, -0.5) * len(want)))[s]
        gone, left = 0, int(want[s] + 1e-9)
        for d in own:
            r = got[d["doc_id"]]
            assert r["taken"] == (left // size[s]) * r["size"] + max(0, min(r["size"], left % size[s] - gone))
            if r["position"] is not None:
                t = r["position"]
                assert (1 + tilt) * t - tilt * t * t == pytest.approx(min(1, gone / left), abs=1e-9)
            gone += r["size"]
    at = [r["position"] for r in got.values() if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert {k: r["taken"] for k, r in run(spark, "op7_mixing").items()} == {k: r["taken"] for k, r in got.items()}


def test_fingerprints(spark, docs):
    got, down = run(spark, "op8_fingerprints"), docs[::-1]
    lines = lambda t: {x for x in t.split("\n") if re.search(r"[^ \t\r\f]", x)}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    by_text = {}
    for k, d in enumerate(down):
        text, after = d["text"] or "", down[(k + 1) % len(down)]["text"] or ""
        n, r = len(text), got[d["doc_id"]]
        edited = text[: n - n // 2] + after[: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(lines(text), lines(edited)))
        assert r["near_next"] == pytest.approx(like(lines(text), lines(after)))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_byte_bpe(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.tokenizer("byte_bpe_50k.tiktoken"), "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op9_byte_bpe")
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = q.queries()[name](spark, SF).select(*columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_pipeline(spark, docs):
    import corpus_pipeline as c

    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in c.STAGES[:3]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        kept[name] = q.shared.stored(out, f"test-{name}")
        frame = kept[name]
    labels = {r["doc_id"]: r["quality"] for r in rows("labels")}
    good = {r["doc_id"] for r in kept["quality"].collect()}
    assert np.mean([(k in good) == (y == 1) for k, y in labels.items()]) > 0.97
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in kept["quality"].collect()}
    root = roots(sets, near_links(sets, 80))
    left = [r["doc_id"] for r in kept["near_duplicates"].collect()]
    assert sorted(left) == sorted(set(root.values()))
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept["near_duplicates"].collect():
        n = len(WORD.findall(r["text"].encode()))
        size[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in kept["mixing"].collect():
        taken[r["source"]] += len(WORD.findall(r["text"].encode()))
    want = targets(size)
    # rows are whole documents: within half of the longest one
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in want)
    assert {(r["doc_id"], r["text"]) for r in kept["mixing"].collect()} <= {(d["doc_id"], d["text"]) for d in docs}
    last = c.STAGES[3][1](spark, kept["mixing"], SF)
    assert last.count() == kept["mixing"].count()
