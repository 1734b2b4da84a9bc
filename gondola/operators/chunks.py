"""Documents cut into chunks along headings and paragraphs, within a token limit.

A section starts at each heading line.  Its paragraphs are packed in order while they
fit the target; a paragraph above the hard limit is cut into windows that overlap.
The tokenizer is given by a factory, which each Python worker calls once.

Defined results: null, empty and blank texts have no chunks.  Text before the first
heading has no heading.  A heading without text below it has no chunk.  Ids may repeat;
each row is cut by itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, ids: list) -> str: ...


class WordTokenizer:
    """Runs of non-blank characters as tokens."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)


class SubwordTokenizer:
    """A vocabulary file of the tokenizers library; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.own = Library.from_file(path)
        self.own.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.own.decode(ids, skip_special_tokens=False)


@dataclass(frozen=True)
class ChunkParams:
    target: int = 400
    limit: int = 512
    overlap: float = 0.15
    heading: str = r"#{1,6}\s.*|\[ITEM\s+\d+[A-Z]?\]"


def sections(text: str, heading: str) -> Iterator[tuple[str | None, str]]:
    """(heading, body) of each section with a body."""
    starts = re.compile(heading)
    title, body = None, []
    for line in [*text.split("\n"), None]:
        if line is None or starts.fullmatch(line.strip()):
            joined = "\n".join(body).strip()
            if joined:
                yield title, joined
            title, body = line and line.strip(), []
        else:
            body.append(line)


def _fitted(text: str, tokenizer: Tokenizer, limit: int) -> tuple[str, int]:
    """Decoded windows may encode to more tokens than they were cut to; shorter cuts follow until they fit."""
    ids = tokenizer.encode(text)
    size = limit
    while len(ids) > limit:
        text = tokenizer.decode(ids[:size])
        ids, size = tokenizer.encode(text), size - max(1, limit // 50)
    return text, len(ids)


def cut(text: str, tokenizer: Tokenizer, params: ChunkParams) -> Iterator[tuple[str | None, str, int]]:
    """(heading, chunk, tokens) in order."""
    for title, body in sections(text, params.heading):
        pack: list[str] = []
        used = 0
        for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", body))):
            ids = tokenizer.encode(paragraph)
            if pack and (len(ids) > params.limit or used + len(ids) > params.target):
                yield title, *_fitted("\n\n".join(pack), tokenizer, params.limit)
                pack, used = [], 0
            if len(ids) > params.limit:
                for at in range(0, len(ids), max(1, int(params.limit * (1 - params.overlap)))):
                    yield title, *_fitted(tokenizer.decode(ids[at : at + params.limit]), tokenizer, params.limit)
            else:
                pack.append(paragraph)
                used += len(ids)
        if pack:
            yield title, *_fitted("\n\n".join(pack), tokenizer, params.limit)


def chunks(docs: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[], Tokenizer] = WordTokenizer, params: ChunkParams = ChunkParams()) -> DataFrame:
    """(id, chunk_no, heading, chunk, tokens): a narrow map, nothing is shuffled."""
    import pyarrow as pa

    names = [id_col, "chunk_no", "heading", "chunk", "tokens"]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows_at_once = 4096

    def run(batches):
        own = tokenizer()
        for batch in batches:
            kind = batch.schema.field(0).type
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (title, chunk, size) in enumerate(cut(text or "", own, params)):
                    out.append((key, n, title, chunk, size))
                    if len(out) >= rows_at_once:
                        yield _arrow(pa, out, names, kind)
                        out = []
            if out:
                yield _arrow(pa, out, names, kind)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, chunk_no int, heading string, chunk string, tokens int")


def _arrow(pa, rows: list[tuple], names: list[str], kind):
    kinds = [kind, pa.int32(), pa.string(), pa.string(), pa.int32()]
    return pa.record_batch([pa.array(values, t) for values, t in zip(zip(*rows), kinds)], names=names)
