"""Contiguous shards of nearly equal size that keep equal texts together.

DataFrame operations only.  Rows are (id, size, checksum, text digest); texts do not
move.  The rows are range-partitioned by text digest, then id, so equal texts are
neighbours; each partition is summed, and the totals give each row the number of
bytes before it.  The whole is to be cut at equal parts.  Where a target falls into a
group of equal texts, the cut moves to the group's nearer edge, so the group stays in
one shard; a group of more bytes than a shard's equal part cannot, and is cut between
the two rows nearest to the target.  A shard differs from its equal part by less than
the largest group that stays whole and the largest row.

At most one row and one group a target are looked up, so the cuts are a table of
fewer rows than shards: broadcasting them does not depend on the data.

Defined results: a null text has one byte (the separator), like an empty one, and
the checksum of no bytes (0); null and empty texts are one group.  Within a group null ids come last;
repeated ids stand in the order in which they are read.  An empty table gives no rows; with fewer groups than
shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm import shared

GROUP = ["text_md5", "size", "text_crc32"]


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, text_md5, shard, slot (gapless from 0 within the shard)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    order = [F.col("text_md5"), F.col("text_crc32"), F.col("size"), F.col("_id").isNull(), F.col("_id")]
    placed = shared.stored(shared.global_prefix(slim, order, "size", "shards"), "shards-placed")
    cuts = _cuts(placed, shards).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))  # one row
    # nothing before the first cut: shard 0; ties of cuts leave a shard empty
    cut = placed.join(F.broadcast(cuts)).withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("before"))))
    # one row a shard
    firsts = cut.groupBy("shard").agg(F.min("rank").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "text_md5", "shard", (F.col("rank") - F.col("_first")).alias("slot"))


def _cuts(placed: DataFrame, shards: int) -> DataFrame:
    """(cut): the byte at which each shard after the first begins; one row for each."""
    target = F.explode(F.expr(f"transform(sequence(1, {max(shards - 1, 1)}), k -> total * k div {shards})"))
    targets = placed.agg(F.sum("size").alias("total")).where(F.col("total").isNotNull()).select("total", target.alias("target"))
    c = F.col
    # the row that holds a target: one for each
    held = placed.join(F.broadcast(targets), (c("before") <= c("target")) & (c("target") < c("before") + c("size")))
    held = held.select("total", "target", *GROUP, c("before").alias("row0"), (c("before") + c("size")).alias("row1"))
    keys = held.select(*GROUP).distinct()
    edges = placed.join(F.broadcast(keys), GROUP, "left_semi").groupBy(*GROUP).agg(F.min("before").alias("group0"), F.max(c("before") + c("size")).alias("group1"))
    whole = c("group1") - c("group0") <= F.expr(f"total div {shards}")
    nearer = lambda a, b: F.when(2 * c("target") < c(a) + c(b), c(a)).otherwise(c(b))
    return held.join(F.broadcast(edges), GROUP).select(F.when(whole, nearer("group0", "group1")).otherwise(nearer("row0", "row1")).alias("cut"))
