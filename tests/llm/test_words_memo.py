"""Words known by their hashes: the table of rows, the memo that starts anew, and hashes that collide."""

import numpy as np

from gondola.llm import bpe, pretokens, token_files
from gondola.llm import queries as q

TEXTS = ["One two, two three!", "it's 12 o'clock", "", "zeta eta \u00e9t\u00e9", "One two"]


def test_slots():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    keys[:500] = np.arange(500, dtype=np.uint64)  # all begin at one place
    slots = pretokens.Slots(3000)
    for part in np.array_split(np.arange(len(keys)), 7):
        assert (slots.find(keys[part]) == -1).all()
        slots.put(keys[part], part)
    assert (slots.find(keys) == np.arange(len(keys))).all()
    assert (slots.find(np.arange(600, 700, dtype=np.uint64)) == -1).all()


def test_memo_starts_anew():
    words = token_files.WordEncoder(q.tokenizer("word_bpe_49k.json"), 4)
    pairs = bpe.vocabulary(q.tokenizer("byte_bpe_50k.tiktoken"))
    for _ in range(3):
        for t in TEXTS:
            assert words.encode([t])[0].tolist() == words.library.encode(t, add_special_tokens=False).ids
            assert pairs.encode([t])[0].tolist() == pairs.plain(t)


def test_collisions(monkeypatch):
    """With a hash of three values words collide within a text and with the memo: ids are the library's all the same."""
    plain = pretokens.runs_hash
    monkeypatch.setattr(pretokens, "runs_hash", lambda *a: plain(*a) % np.uint64(3))
    words = token_files.WordEncoder(q.tokenizer("word_bpe_49k.json"), 1000)
    for t in ["one", "two", "ten", "six", *TEXTS]:
        assert [x.tolist() for x in words.encode([t, t + " four"])] == [words.library.encode(x, add_special_tokens=False).ids for x in (t, t + " four")]
