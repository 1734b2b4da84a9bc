"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in SQL functions only.

A document is the set of hashes of its paragraphs (lines that are not blank).  A
sketch has three groups of cells; every hash falls into one cell of each group and
changes its count, the XOR of hashes and the XOR of check hashes.  Sketches of two
versions subtract cell by cell: what both have cancels.  A cell with count 1 or -1
whose check fits holds one hash of the difference; peeling takes such hashes out
of their cells until all cells are empty.

The fingerprint is a sketch of fixed size.  Where the difference is too large for
it, peeling stops early; both versions are then sketched again, larger, in groups
of bounded size, and a group that fails again and again with twice the cells and another salt
(`tries`).  A try fails for a few groups in a hundred at most, and the tries are independent;
should all fail (never seen), the job ends with an error rather than with a guess.

Likeness of two documents with a and b paragraphs that differ in d is
(a + b - d) / (a + b + d), the Jaccard similarity of the sets; of two documents
without paragraphs it is 1.

Defined results: null and empty texts and texts of blank lines have no paragraphs.
Repeated paragraphs count once.  Repeated ids: by text hash, descending; null ids
come last.  Of equal rows (id and text) each but the last has an equal one as its next document.
An empty table gives no rows; the only document is its own next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm import shared


@dataclass(frozen=True)
class SketchParams:
    cells: int = 8  #: per group of cells, three groups
    rounds: int = 12  #: of peeling; each takes all cells that are pure
    group: int = 48  #: hashes of both sides that one larger sketch takes: so many to twice as many on average
    task_bytes: int = 8 << 20  #: text that one task shuffles
    sketch_bytes: int = 8 << 20  #: text whose sketches one task makes
    tries: tuple[int, ...] = (1, 2, 4, 8, 16, 32)  #: sizes of the larger sketches, each with another salt


CHECK = "xxhash64({0}, 77)"
_names = iter(f"v{i}" for i in range(10**9))


def _let(value: str, body) -> str:
    """SQL that computes value once and gives its name to body."""
    name = next(_names)
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _falls(d: str, i: str, m: str, salt: int) -> str:
    return f"pmod(xxhash64({d}, {salt} + {i} div {m}), {m}) = {i} % {m}"


def sketch(hashes: str, m: str, salt: int) -> str:
    """SQL: the cells of an array of hashes."""
    i, d, s = next(_names), next(_names), next(_names)
    return (
        f"transform(sequence(0, 3 * {m} - 1), {i} -> aggregate(filter({hashes}, {d} -> {_falls(d, i, m, salt)}), "
        f"named_struct('c', 0, 'k', 0L, 'h', 0L), "
        f"({s}, {d}) -> named_struct('c', {s}.c + 1, 'k', {s}.k ^ {d}, 'h', {s}.h ^ {CHECK.format(d)})))"
    )


def peeled(a: str, b: str, m: str, salt: int, rounds: int) -> str:
    """SQL: how many hashes two sketches differ in; null where peeling does not end."""
    x, y, s, r, i, d, p, z = (next(_names) for _ in range(8))
    diff = f"zip_with({a}, {b}, ({x}, {y}) -> named_struct('c', {x}.c - {y}.c, 'k', {x}.k ^ {y}.k, 'h', {x}.h ^ {y}.h))"
    pure = (
        f"array_distinct(transform(filter({s}.cells, {x} -> abs({x}.c) = 1 and {x}.h = {CHECK.format(x + '.k')}), "
        f"{x} -> named_struct('k', {x}.k, 'c', {x}.c)))"
    )
    without = (
        f"transform({s}.cells, ({x}, {i}) -> aggregate(filter({p}, {d} -> {_falls(d + '.k', i, m, salt)}), {x}, "
        f"({z}, {d}) -> named_struct('c', {z}.c - {d}.c, 'k', {z}.k ^ {d}.k, 'h', {z}.h ^ {CHECK.format(d + '.k')})))"
    )
    step = f"transform(array({pure}), {p} -> if(size({p}) = 0, {s}, named_struct('cells', {without}, 'found', {s}.found + size({p}))))[0]"
    return (
        f"aggregate(sequence(1, {rounds}), named_struct('cells', {diff}, 'found', 0), ({s}, {r}) -> {step}, "
        f"{s} -> if(exists({s}.cells, {x} -> {x}.c <> 0 or {x}.k <> 0L or {x}.h <> 0L), null, {s}.found))"
    )


def dealt(hashes: str, levels: str) -> str:
    """SQL: an array of hashes as 2**levels arrays, by the bits of the hashes: each level halves all parts, so a hash is looked at twice a level."""
    acc, bit, part, x = (next(_names) for _ in range(4))
    half = lambda side: f"filter({part}, {x} -> (shiftright({x}, 17 + {bit}) & 1) = {side})"
    return f"aggregate(slice(sequence(0, 40), 1, {levels}), array({hashes}), ({acc}, {bit}) -> flatten(transform({acc}, {part} -> array({half(0)}, {half(1)}))))"


def larger(a: str, b: str, times: int, salt: int, params: SketchParams) -> str:
    """SQL: how many hashes two arrays differ in, by one try for each group of them; null where one fails."""
    return tried(a, b, [(times, salt)], params, "null")


def tried(a: str, b: str, tries: list[tuple[int, int]], params: SketchParams, otherwise: str) -> str:
    """SQL: how many hashes two arrays differ in, by sketches large enough for all of both.

    Group by group: only a group whose sketch does not peel is tried again, larger and with another salt, so the work does not grow with the number of groups that must all succeed.
    """
    p, q, x, y = (next(_names) for _ in range(4))

    def both(times: int, salt: int) -> str:
        return _let(
            f"cast({times} * (5 + (size({p}) + size({q})) * 11 div 20) as int)",
            lambda m: peeled(sketch(p, m, salt), sketch(q, m, salt), m, salt, params.rounds + 4 * times))

    found = ", ".join([*(both(*t) for t in tries), f"cast({otherwise} as int)"])
    each = lambda levels: f"zip_with({dealt(a, levels)}, {dealt(b, levels)}, ({p}, {q}) -> coalesce({found}))"
    levels = f"cast(floor(log2(greatest(1, (size({a}) + size({b})) / {params.group}))) as int)"
    return f"aggregate({_let(levels, each)}, 0, ({x}, {y}) -> {x} + {y})"


def likeness(a: str, b: str, sa: str, sb: str, params: SketchParams) -> str:
    """SQL: likeness of two arrays of hashes with their fingerprint sketches."""
    m = f"{params.cells}"
    # a difference of more hashes than cells cannot peel
    small = f"if(abs(size({a}) - size({b})) >= {3 * params.cells}, null, {peeled(sa, sb, m, 0, params.rounds)})"
    more = tried(a, b, [(t, 1000 * t) for t in params.tries], params, "raise_error('no sketch peels')")
    return _let(f"coalesce({small}, {more})", lambda d: (
        f"if(size({a}) + size({b}) = 0, 1.0D, cast(size({a}) + size({b}) - {d} as double) / (size({a}) + size({b}) + {d}))"))


def paragraphs(text: str) -> str:
    """SQL: distinct hashes of the lines of a text that are not blank."""
    x = next(_names)
    return f"array_distinct(transform(filter(split({text}, '\\n'), {x} -> {x} rlike '[^ \\\\t\\\\r\\\\f]'), {x} -> xxhash64({x})))"


def written(cells: str, hashes: str) -> str:
    """SQL: a sketch as text."""
    x = next(_names)
    return f"concat(size({hashes}), '/', array_join(transform({cells}, {x} -> concat({x}.c, ':', lower(hex({x}.k)), ':', lower(hex({x}.h)))), ','))"


#: A distinct (id, text), in descending order of ids: nulls last, ties by text hash.  Descending as ascending complements, which cannot overflow.
KEY = ["z", "i", "x", "y"]


def _ordered(rows: DataFrame) -> DataFrame:
    """(KEY, n, m, bytes, before): one row a distinct document with its code points, copies, and KEY and n of the document before it.

    Before the first comes the last.  No text is moved: rows are range-partitioned by
    KEY, and neighbours across partitions meet in a table of one row a partition.
    """
    slim = rows.groupBy(*KEY).agg(F.first("n").alias("n"), F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    laid = shared.stored(slim.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "sketch-order")
    me = F.struct(*KEY, "n")
    by_part = Window.orderBy("part")
    ends = laid.groupBy("part").agg(F.max(me).alias("last"))
    across = ends.select("part", F.coalesce(F.lag("last").over(by_part), F.max("last").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("across"))
    inside = laid.withColumn("inside", F.lag(me).over(Window.partitionBy("part").orderBy(*KEY)))
    # one row for each partition of the range shuffle: a bound that data cannot exceed
    return inside.join(F.broadcast(across), "part").withColumn("before", F.coalesce("inside", "across")).drop("part", "inside", "across")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(_id, n, m, text, start, b) and the bytes of all texts: start is what the next document gives to the edited text, b its paragraphs.

    The next document is that by descending id; after the last one the first.  One row stands for m
    equal rows (id and text); of these all but one have an equal row as the next one.
    Texts are shuffled once; to its predecessor a document sends the start of its text that is wanted there, and its hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("text")).select(
        F.col("_id").isNull().alias("z"), F.bitwise_not(F.coalesce("_id", F.lit(0))).alias("i"), F.bitwise_not(F.xxhash64("text")).alias("x"),
        F.bitwise_not(F.crc32(F.col("text").cast("binary"))).alias("y"), "text")
    sizes = rows.select(*KEY, F.char_length("text").alias("n"), F.octet_length("text").cast("long").alias("bytes"))
    order = shared.stored(_ordered(sizes), "sketch-neighbours")
    total = order.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    own = rows.groupBy(*KEY).agg(F.first("text").alias("text")).join(order, KEY)
    sent = own.select(*[F.col(f"before.{k}").alias(k) for k in KEY], F.expr("left(text, cast(before.n div 2 as int))").alias("start"), F.expr(paragraphs("text")).alias("b"))
    met = own.select(*KEY, "text", "n", "m").join(sent, KEY)
    return met.select(F.when(~F.col("z"), F.bitwise_not("i")).alias("_id"), F.col("n").cast("long").alias("n"), "m", "text", "start", "b"), total


def fingerprints(docs: DataFrame, params: SketchParams = SketchParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends, in place of its last n_chars // 2 code points, with the
    first as many of the next document.
    """
    found, total = with_next(docs, id_col, text_col)
    # the row whose next document is another one, and the equal rows before it
    one = F.struct("start", "b", F.lit(1).cast("long").alias("times"))
    equal = F.struct(F.expr("left(text, cast(n div 2 as int))").alias("start"), F.expr(paragraphs("text")).alias("b"), (F.col("m") - 1).alias("times"))
    rows = found.withColumn("v", F.explode(F.when(F.col("m") > 1, F.array(one, equal)).otherwise(F.array(one))))
    texts = rows.select("_id", F.col("n").alias("n_chars"), "text", "v.b", "v.times", F.expr("concat(left(text, cast(n - n div 2 as int)), v.start)").alias("edited"))
    hashed = texts.select(
        "_id", "n_chars", "times", F.sha2("edited", 256).alias("edited_sha256"), F.expr(paragraphs("text")).alias("a"), F.expr(paragraphs("edited")).alias("e"), "b")
    with shared.shuffle_tasks(docs.sparkSession, total // params.task_bytes):
        hashed = shared.stored(hashed, "sketch-paragraphs")
    # sketching takes many times longer than reading its input: dealt anew, by the bytes of the texts
    hashed = hashed.repartition(max(int(total // params.sketch_bytes), 1), "_id", "edited_sha256")
    m = f"{params.cells}"
    sketched = hashed.withColumns({f"s{x}": F.expr(sketch(x, m, 0)) for x in "aeb"})
    out = sketched.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.expr(written("sa", "a")).alias("fingerprint"),
        F.expr(written("se", "e")).alias("edited_fingerprint"), F.expr(likeness("a", "e", "sa", "se", params)).alias("near_edited"),
        F.expr(likeness("a", "b", "sa", "sb", params)).alias("near_next"), "times")
    # equal rows again, in steps whose arrays stay small
    steps = out.withColumn("step", F.explode(F.expr("sequence(0L, (times - 1) div 4096)")))
    return steps.withColumn("copy", F.explode(F.expr("sequence(1L, least(4096L, times - step * 4096L))"))).drop("times", "step", "copy")
