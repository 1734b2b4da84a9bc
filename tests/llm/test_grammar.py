"""Re-Pair goes on until no pair is frequent; one document needs no other's block."""

from collections import Counter

import numpy as np

from gondola.llm import token_files

PARAMS = token_files.TokenFileParams(least=4, block=64)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    phrase = rng.permutation(np.arange(2, 3002))  # 3000 ids, repeated: 12 rounds of halving
    docs = [np.append(np.concatenate([phrase, [3003] * 41]), 1) for _ in range(12)]
    ids = np.concatenate(docs).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, ends, rules = token_files.repair(ids, last, 4000, PARAMS)
    assert (token_files.expand(symbols, rules, 4000) == ids).all()
    free, count = {}, Counter()
    for k in range(len(symbols) - 1):
        pair = int(symbols[k]), int(symbols[k + 1])
        if not ends[k] and free.get(pair, -1) < k:
            count[pair] += 1
            free[pair] = k + 1 if pair[0] == pair[1] else k
    assert max(count.values(), default=0) < PARAMS.least


def test_blocks_apart():
    docs = [np.append(np.random.default_rng(k).integers(2, 900, 200), 1).astype(np.uint32) for k in range(9)]
    data = bytearray(token_files.pack_shard(list(range(9)), docs, 1000, PARAMS))
    data[-40:] = bytes(40)  # the last block is lost, the first documents are not
    shard = token_files.Shard(bytes(data))
    assert all((shard.document(k) == docs[k]).all() for k in range(8))
