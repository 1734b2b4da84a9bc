"""Fill-in-the-middle: texts rearranged at unit borders, with ropes.

A text becomes a rope: a balanced tree whose leaves are short slices; leaves and
inner nodes cache how many units end in them and how many code points they have.
Two unit ranks split the tree into prefix, middle and suffix (only the nodes on two paths from the
root are made anew), which are joined in another order with sentinels between them.
The inverse is a rope of the output, split at the code-point ranks of its sentinels.

Where a document is cut, and into which form, follows from a digest of seed and id,
so that reruns and other partitions agree.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` the text as it is.

Defined results: a null text is empty.  An empty text, and one that contains a
sentinel, stays plain (it could not be told apart).  A null id draws as the seed alone.  Equal rows
get equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm import shared

#: What ends a unit; code points need no end, each is a unit.
UNIT_ENDS = {"line": "\n", "char": ""}
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FimParams:
    unit: str = "line"
    rate: int = 100  #: per cent of the texts that are rearranged
    spm_rate: int = 50  #: per cent of these in the form spm
    seed: int = 7
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    leaf: int = 4096  #: code points of a leaf

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Rope:
    """A leaf (text) or a node (left, right); ends: units that end in it, chars: its code points."""

    __slots__ = ("left", "right", "text", "ends", "chars")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, text: str = "", ends: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.ends, self.chars = ends, len(text)
        else:
            self.ends, self.chars = left.ends + right.ends, left.chars + right.chars


def leaf(text: str, end: str) -> Rope:
    return Rope(text=text, ends=text.count(end) if end else len(text))


def rope(text: str, end: str, size: int) -> Rope:
    """A balanced rope of a text."""
    level = [leaf(text[i : i + size], end) for i in range(0, len(text), size)] or [leaf("", end)]
    while len(level) > 1:
        pairs = [Rope(a, b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def joined(*ropes: Rope) -> Rope:
    out = ropes[0]
    for x in ropes[1:]:
        out = Rope(out, x)
    return out


def split_leaf(x: Rope, at: int, end: str) -> tuple[Rope, Rope]:
    return leaf(x.text[:at], end), leaf(x.text[at:], end)


def after_end(text: str, rank: int, end: str) -> int:
    """The place behind the rank-th unit end of a leaf's text."""
    at = 0
    for _ in range(rank):
        at = text.index(end, at) + len(end)
    return at


def split(x: Rope, rank: int, end: str, chars: bool = False) -> tuple[Rope, Rope]:
    """x up to and including its rank-th unit end (or, with chars, code point), and the rest."""
    if x.left is None:
        return split_leaf(x, rank if chars or not end else after_end(x.text, rank, end), end)
    held = x.left.chars if chars else x.left.ends
    if rank <= held:
        a, b = split(x.left, rank, end, chars)
        return a, Rope(b, x.right)
    a, b = split(x.right, rank - held, end, chars)
    return Rope(x.left, a), b


def leaves(x: Rope) -> Iterator[str]:
    stack = [x]
    while stack:
        node = stack.pop()
        if node.left is None:
            yield node.text
        else:
            stack += [node.right, node.left]


def units(x: Rope, text: str, end: str) -> int:
    """The units of a rope; the last one may lack its end."""
    return x.ends + bool(end and text and not text.endswith(end))


def cut(x: Rope, rank: int, n: int, end: str) -> tuple[Rope, Rope]:
    """x split after `rank` of its n units."""
    return split(x, x.chars, end, chars=True) if rank == n else split(x, rank, end)


def rearranged(text: str, draws: tuple[int, int, int, int], params: FimParams) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    end = UNIT_ENDS[params.unit]
    whole = rope(text, end, params.leaf)
    n = units(whole, text, end)
    if not text or draws[2] % 100 >= params.rate or any(s in text for s in params.sentinels):
        return n, PLAIN, None, None, text
    one, two = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    rest, suffix = cut(whole, two, n, end)
    prefix, middle = cut(rest, one, two, end)
    p, s, m = (leaf(x, end) for x in params.sentinels)
    if draws[3] % 100 < params.spm_rate:
        form, out = SPM, joined(s, suffix, p, prefix, m, middle)
    else:
        form, out = PSM, joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, "".join(leaves(out))


def restored_text(output: str, form: str, params: FimParams) -> str:
    """The text that rearranged() took, from its output and form."""
    if form == PLAIN:
        return output
    end = UNIT_ENDS[params.unit]
    order = [params.suffix, params.prefix, params.middle] if form == SPM else [params.prefix, params.suffix, params.middle]
    tree, parts, gone = rope(output, end, params.leaf), {}, 0
    starts = [output.index(s) for s in order]
    for name, start, stop in zip(order, starts, [*starts[1:], len(output)]):
        _, tree = split(tree, start + len(name) - gone, end, chars=True)  # the sentinel itself
        parts[name], tree = split(tree, stop - start - len(name), end, chars=True)
        gone = stop
    return "".join(leaves(joined(parts[params.prefix], parts[params.middle], parts[params.suffix])))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars, output."""
    shared.bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>")
    def arrange(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        drawn = zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), d.to_pylist())
        found = [rearranged(x or "", four, params) for x, four in zip(texts.to_pylist(), drawn)]
        columns = list(zip(*found)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col), arrange(F.col(text_col), *draws(F.col(id_col), params.seed)).alias("x")).select(id_col, "x.*")


def restored(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The texts that transformed() took."""

    @F.arrow_udf("string")
    def undo(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([restored_text(x, f, params) for x, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.string())

    return undo(output, form)
