"""What a statement will read, before it runs: bytes of the columns and row groups that its scans need, out of Parquet footers.

The plan says which files, columns and filters each scan has; the footers, read by tasks, which row groups the filters' bounds leave
and how large the columns' chunks in them are.  Pages that Spark skips within a row group count, so the estimate is an upper bound of the data; footers
themselves do not count.  Scans of other formats count their files whole; rows that a session holds count nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bytes that one question may read.
MOST_BYTES = 100_000_000


class TooMuch(ValueError):
    """A statement would read more bytes than it may; it was not started."""


@dataclass(frozen=True)
class Scan:
    files: tuple[str, ...]
    columns: tuple[str, ...]
    filters: tuple[tuple[str, str, str], ...]  #: (comparison, column, value as text)


_FILTER = re.compile(r"(EqualTo|GreaterThan|GreaterThanOrEqual|LessThan|LessThanOrEqual)\((\w+),([^(),]*)\)")


def scans(df: DataFrame) -> list[Scan]:
    """The file scans of a plan."""
    leaves, found = df._jdf.queryExecution().sparkPlan().collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        pushed = leaf.metadata().get("PushedFilters")
        text = pushed.get() if pushed.isDefined() else "[]"
        conjuncts = _conjuncts(text[1:-1])
        filters = tuple(m.groups() for part in conjuncts if (m := _FILTER.fullmatch(part)))
        found.append(Scan(tuple(leaf.relation().location().inputFiles()), tuple(leaf.requiredSchema().fieldNames()), filters))
    return found


def _conjuncts(text: str) -> list[str]:
    """The filters of a list, cut at the commas outside of parentheses."""
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[start:k].strip())
            start = k + 1
    return [*out, text[start:].strip()]


def _as(value: str, like: object) -> object | None:
    """A filter's value in the type of a statistic; None where that is not known."""
    try:
        if isinstance(like, bool) or like is None:
            return None
        if isinstance(like, datetime):
            at = datetime.fromisoformat(value.replace("Z", "+00:00"))
            return at.replace(tzinfo=at.tzinfo or timezone.utc) if like.tzinfo else at.replace(tzinfo=None)
        if isinstance(like, date):
            return date.fromisoformat(value)
        return type(like)(value) if isinstance(like, (str, float, Decimal)) else int(value) if isinstance(like, int) else None
    except (ValueError, InvalidOperation):
        return None


_LEFT_OUT: dict[str, Callable] = {
    "EqualTo": lambda low, high, v: v < low or v > high, "GreaterThan": lambda low, high, v: high <= v, "GreaterThanOrEqual": lambda low, high, v: high < v,
    "LessThan": lambda low, high, v: low >= v, "LessThanOrEqual": lambda low, high, v: low > v}


def chunk_bytes(metadata: pq.FileMetaData, scan: Scan) -> int:
    """Bytes of a file's column chunks that a scan reads."""
    total = 0
    for g in range(metadata.num_row_groups):
        group, size, out = metadata.row_group(g), 0, False
        for c in range(group.num_columns):
            chunk = group.column(c)
            name = chunk.path_in_schema.split(".")[0]
            if name in scan.columns:
                size += chunk.total_compressed_size
            stats = chunk.statistics
            if stats is not None and stats.has_min_max and chunk.path_in_schema == name:
                for kind, column, value in scan.filters:
                    v = _as(value, stats.min) if column == name else None
                    out = out or (v is not None and _LEFT_OUT[kind](stats.min, stats.max, v))
        total += 0 if out else size
    return total


def estimated_bytes(df: DataFrame, files_per_task: int = 64) -> int:
    """Bytes that df's scans will read; footers are read by tasks, and only sums come back."""
    spark = df.sparkSession
    every = scans(df)
    if not every:
        return 0
    asked = [(k, f) for k, s in enumerate(every) for f in s.files]
    rows = spark.createDataFrame(asked, "scan int, file string").repartition(max(len(asked) // files_per_task, 1))

    def measure(batches):
        for batch in batches:
            sizes = []
            for k, file in zip(batch["scan"].to_pylist(), batch["file"].to_pylist()):
                system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(path) as source:
                    try:
                        sizes.append(chunk_bytes(pq.read_metadata(source), every[k]))
                    except pa.ArrowInvalid:  # not Parquet
                        sizes.append(source.size())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["bytes"])

    return rows.mapInArrow(measure, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]


def capped(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df, unless it would read more than most_bytes."""
    n = estimated_bytes(df)
    if n > most_bytes:
        raise TooMuch(f"{n} bytes to read, {most_bytes} allowed")
    return df
