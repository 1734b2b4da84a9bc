"""The whole pipeline against brute force, and its stages on odd tables."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN

import corpus_pipeline
from gondola.llm import queries as q
from gondola.llm import shared

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    with open(q.tokenizer("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark, library, monkeypatch):
    """Each stage works on all that the one before kept; the last one's rows are the library's ids of the mixed texts."""
    kept = {}
    plain = shared.stored

    def watched(df, name):
        out = plain(df, name)
        if name.startswith("pipeline-"):
            kept[name.removeprefix("pipeline-")] = out
        return out

    monkeypatch.setattr(corpus_pipeline.shared, "stored", watched)
    last = corpus_pipeline.run(spark, SF).collect()
    assert list(kept) == [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count(), *(kept[n].count() for n in ("quality", "near_duplicates"))]
    assert counts[0] > counts[1] > counts[2] > 0
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, kept["quality"], kept["near_duplicates"], kept["mixing"])]
    assert ids[0] > ids[1] > ids[2] >= ids[3]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(k in ids[1]) == (y == 1) for k, y in labels.items()]) > 0.97
    want = Counter((r["doc_id"], digest(library.encode_ordinary(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept["mixing"].collect())
    assert Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in last) == want
    assert all(digest(r["tokens"]) == r["ids_sha256"] and len(r["tokens"]) == r["n_tokens"] for r in last)
    whole = {r["doc_id"]: r["text"] for r in kept["near_duplicates"].collect()}
    assert all(whole[r["doc_id"]] == r["text"] for r in kept["mixing"].collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, cid long, row_key string"
ODD = [(1, "a plain text of some words here", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (1, "a plain text of some words here", "en", "s"), (None, "\u4e2d\u6587 x", "en", None), (4, "w " * 30_000, "en", "t")]


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, None)], [(1, 0), (4, 0)], [(1, 1), (1, 0), (None, 1), (4, 1)]])
def test_odd_tables(spark, tmp_path, library, labels):
    """Null texts and ids, repeated rows, clashing columns; labels of one class, of none, or unknown."""
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 0.5, 7, "k") for r in ODD], COLUMNS)
    for frame, rows in ((docs, len(ODD)), (docs.limit(0), 0)):
        x = frame
        for name, stage in corpus_pipeline.STAGES[:3]:
            x = shared.stored(stage(spark, x, str(tmp_path)), f"odd-{name}")
            assert x.columns == frame.columns
        last = corpus_pipeline.STAGES[3][1](spark, x, str(tmp_path)).collect()
        assert len(last) == x.count() and (rows or not last)
        texts = Counter((r["doc_id"], digest(library.encode_ordinary(r["text"] or ""))) for r in x.collect())
        assert Counter((r["doc_id"], r["ids_sha256"]) for r in last) == texts
