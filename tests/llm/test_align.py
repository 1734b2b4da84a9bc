"""Alignment of tokenizers against the libraries, with plain loops over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, pre_tokenizers

from gondola.llm import align
from gondola.llm import queries as q
from gondola.llm import shared

SF = "/root/testdata/sf0.01"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def byte_of():
    """The byte of each character, from what the library itself makes of every byte."""
    found = {}
    for cp in [*range(0x800), *range(0x1000, 0x10000, 0x1000), 0x800, *range(0x10000, 0x110000, 0x10000)]:
        text = chr(cp)
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
        found |= dict(zip(shown, text.encode()))
    return found


BYTES = byte_of()


def plain(libraries, text):
    """(A ids, B ids) by group of one text."""
    a, b = libraries
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(BYTES.get(c, 0) for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return []
    ends = [set(np.cumsum([len(x) for x in raw]).tolist()) for raw in (raw_a, raw_b)]
    both = sorted(ends[0] & ends[1])
    groups = [([], []) for _ in both]
    for side, ids, raw in ((0, ids_a, raw_a), (1, ids_b, raw_b)):
        g, at = 0, 0
        for i, x in zip(ids, raw):
            at += len(x)
            groups[g][side].append(i)
            g += at == both[g]
    return groups


def expected(libraries, rows):
    found = [(i, plain(libraries, t)) for i, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, q.op13_alignment(spark, SF).collect()), key=str) == expected(libraries, rows)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a "), (6, "a  b   c \n\n d\n"), (7, "\n"), (8, "x\n y"), (9, "\tif x:\n\t\treturn 1\n"), (10, "\u2581literal"), (11, "<|endoftext|> and <s> </s> <unk>"),
    (12, "na\u00efve caf\u00e9 \u4e2d\u6587\u5b57\u7b26 \U0001f600\U0001f468\u200d\U0001f469 \u2460 \ufb01"), (13, "don't we'll it's"), (14, "a\u00a0b\u2003c\u3000d\u180ee\u200b f\x1c g\x85 h"), (15, "same words here"), (15, "same words here"),
    (None, "no id"), (16, "q" * 5000), (17, "the end " * 20_000), (18, "\x00\x01 \x7f\r\n\r\n"), (19, "1234567 12,345.67 --==~~ ???"), (20, "x" + " " * 300 + "y"), (21, "\u4e2d" * 3000)]


def run(spark, rows, params=align.AlignParams()):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keys string").repartition(3)
    found = align.aligned(docs, *PATHS, params)
    counts = align.pair_counts(found, shared.work_path(spark, "pairs"), params)
    return sorted(map(tuple, align.with_counts(found, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_edges(spark, libraries):
    assert run(spark, ODD) == expected(libraries, ODD)
    assert run(spark, []) == []
    assert [r[1:] for r in run(spark, [(1, None), (2, "")])] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_small_tables(spark, libraries):
    """Tables that overflow all the time, groups paired by distinct ids, many shards: the same results."""
    assert run(spark, ODD, align.AlignParams(memo=3, memo_links=10, wide=2, partial=20)) == expected(libraries, ODD)


def test_groups(spark, libraries):
    docs = spark.createDataFrame([(1, "naïve tokenization")], "doc_id long, text string")
    row = align.aligned(docs, *PATHS, groups=True).first()
    assert row.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain(libraries, "naïve tokenization"))
    keys, times = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["times"], "<i8")
    assert (np.diff(keys) > 0).all() and times.sum() == row.n_links


def test_whole_texts_where_pieces_cross():
    """A vocabulary with a piece over a border has its texts encoded whole."""
    both = align.Aligner(*PATHS, align.AlignParams())
    assert both.cuts and both.segments("a b\nc  d") == [" a", " b", "\nc", "  d"]
    both.cuts = False
    assert both.segments("a b") == [" a b"]
