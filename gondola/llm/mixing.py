"""Mixing sources to target weights along a curriculum.

Targets.  Sources in code point order (null last) weigh by `weights`, repeating;
together they take `share` times all words; a source gives at most `most` times
its words, and what it cannot give goes to the others by weight (water filling:
one pass over sources sorted by cap per weight).

Words.  Within a source, documents stand in the order of their ids' digests.  The source's
target is cut from as many passes over that order as it needs: whole passes, and
a last one that ends at the target, in the middle of a document where need be (`taken` counts its words).
Rows of the mix are whole documents: that last one is taken if at least half of it is wanted, else left out, so a
source's words are within half of a document of its target.

Positions.  While the mix is consumed, at time t from 0 to 1, a source's weight
follows a schedule 1 + a*(1 - 2t); `tilts` gives a (above 0: early; below: late).
Its integral (1 + a)t - a*t*t is the part of the source's words that are demanded
by t; inverting it at a document's place gives its position.  Documents are
range-sorted by position.

Prefix sums run over range partitions of (source, digest), so one source may hold
most of the rows.  Targets are windows over a table of one row a source, sorted in one
task: 24 bytes a source, so some ten million sources are its bound.

Defined results: null texts have no words and are taken with 0 words; documents
without words have a null position unless their source is taken.  A null source is
a source.  Repeated rows are documents of their own.  Without any words all
targets are 0.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm import shared

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3, 1, 2)
    tilts: tuple[float, ...] = (0.5, 0.0, -0.5)
    share: float = 1.5
    most: float = 2.0


def source_targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, target, tilt, base): base is the words of all sources before it.

    sizes has one row per source, so the windows here are over sources, not rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    k = F.row_number().over(by_name) - 1
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("k") % len(values) + 1).cast("int"))
    named = sizes.withColumns({"k": k, "base": F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    named = named.withColumns({"w": pick(params.weights), "tilt": pick(params.tilts), "cap": F.col("source_size") * params.most})
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(
        F.sum("source_size").over(every) * params.share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = named.withColumn("full", F.coalesce(F.col("cap") <= level * F.col("w"), F.lit(True)))
    rest = F.sum("source_size").over(every) * params.share - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return full.select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.try_divide(rest * F.col("w"), weight)).alias("target"), "tilt", "base")


#: Two hashes of all columns, with seeds of their own: rows of one key are equal, but for a chance of 2**-128 a pair.
KEY = ["row_key", "row_key2"]


def keyed(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *docs.columns).alias(name) for seed, name in enumerate(KEY)]


def plan(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, source, row_key, row_key2, size, source_size, target, taken, passes.

    row_key and row_key2: KEY.  passes: array of (position, words), in time order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), *keyed(docs),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_by"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    laid = shared.stored(
        shared.global_prefix(slim, [F.col("source").isNull(), F.col("source"), F.col("_by"), *map(F.col, KEY)], "size", "mix-order"),
        "mix-rows")
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = shared.stored(source_targets(sizes, params), "mix-targets").withColumnRenamed("source", "_s")
    rows = laid.join(targets, laid.source.eqNullSafe(targets._s)).drop("_s")
    want = F.col("want")
    at = F.col("before") - F.col("base")
    size, all_words = F.col("size"), F.col("source_size")
    rows = rows.withColumn("want", F.floor("target").cast("long")).withColumn("at", at)
    rows = rows.withColumn("rounds", F.coalesce(F.expr("try_divide(want, source_size)").cast("long"), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(size, want - F.col("rounds") * all_words - F.col("at")))
    rows = rows.withColumn("part", part)
    # place of pass j of this document in its source's demand, as a part of it
    u = lambda j: F.least(F.lit(1.0), F.try_divide((j * all_words + F.col("at")).cast("double"), want.cast("double")))
    a = F.col("tilt")
    time = lambda x: F.when(a == 0, x).otherwise(((1 + a) - F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * x))) / (2 * a) + F.lit(0.0))
    whole = F.when(F.col("rounds") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("rounds") - 1, F.lit(0))), lambda j: F.struct(time(u(j)).alias("position"), size.alias("words"))))
    last = F.when(F.col("part") > 0, F.array(F.struct(time(u(F.col("rounds"))).alias("position"), F.col("part").alias("words"))))
    empty = F.array().cast("array<struct<position:double,words:bigint>>")
    return rows.select(
        F.col("_id").alias(id_col), "source", *KEY, "size", "source_size", "target",
        (F.col("rounds") * size + F.col("part")).alias("taken"), F.concat(F.coalesce(whole, empty), F.coalesce(last, empty)).alias("passes"))


def mixed_report(docs: DataFrame, params: MixParams = MixParams(), **names: str) -> DataFrame:
    """One row per row of docs, range-sorted by the position of its first pass (nulls last)."""
    found = plan(docs, params, **names)
    return found.withColumn("position", F.try_element_at("passes", F.lit(1))["position"]).drop("passes", *KEY).orderBy(
        F.col("position").asc_nulls_last(), F.col(found.columns[0]))


def mixed_rows(docs: DataFrame, params: MixParams = MixParams(), text_col: str = "text", **names: str) -> DataFrame:
    """docs as the mix takes them: a row, whole, for each pass, in position order.

    The document in which a source's last pass ends is taken if at least half of its words are wanted, else left out.
    Equal rows share a key; their passes are joined to one of them.  Documents
    without words are in every whole pass of their source.
    """
    passes = plan(docs, params, text_col=text_col, **names).select(*KEY, "size", F.explode("passes").alias("p")).where("2 * p.words >= size")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), *keyed(docs))
    rows = whole.dropDuplicates(KEY).join(passes, KEY)
    return rows.orderBy(F.col("p.position").asc_nulls_last(), *KEY).select("doc.*")
