"""Contents of added tokens in texts, against the library as its file defines it."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from gondola.llm import queries as q
from gondola.llm import shared, token_files

TEXTS = ["a <|endoftext|> b", "<|startoftext|>One two", "A<|endoftext|>b<|endoftext|>", "no <|ENDOFTEXT|> here", "a <| endoftext |>", "plain words", "é <|endoftext|> 中", None]


def test_added_tokens(spark):
    path = q.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [320, 49407, 321]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = token_files.write_tokens(docs, path, shared.work_path(spark, "t"))
    start = 0
    for r in token_files.with_starts(index, token_files.read_tokens(index)).orderBy("start").collect():
        ids = np.array([*library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
