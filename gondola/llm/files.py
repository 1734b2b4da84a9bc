"""Byte files in the shared folder, opened by executors through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_tasks(index: DataFrame, task_bytes: int) -> DataFrame:
    """index in order of file and offset, dealt by the bytes that its rows stand for, not by their number."""
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    return index.repartitionByRange(int(total // task_bytes) + 1, "file", "offset").sortWithinPartitions("file", "offset")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Appender:
    """Writes byte strings to new files below a folder; each file ends after `limit` bytes.

    Names are unique for every task attempt: an attempt that is lost leaves files
    that no index names.
    """

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder.rstrip("/"), suffix, limit
        self.fs, self.path = opened(self.folder)
        self.fs.create_dir(self.path, recursive=True)
        self.out, self.at, self.name = None, 0, ""

    def add(self, data: bytes) -> tuple[str, int]:
        """The file and offset that data got."""
        if self.out is None:
            name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.at, self.name = self.fs.open_output_stream(f"{self.path}/{name}", compression=None), 0, f"{self.folder}/{name}"
        at, name = self.at, self.name
        self.out.write(data)
        self.at += len(data)
        if self.at >= self.limit:
            self.close()
        return name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def ranged_reads(rows, gap: int, most: int) -> Iterator[tuple[tuple, bytes]]:
    """(row, its bytes) for rows (file, offset, length, ...) sorted by file and offset.

    Neighbouring ranges, up to `gap` bytes apart, are fetched by one read of at most
    `most` bytes (or one record, where that is longer).
    """
    group, source, name = [], None, None

    def fetch():
        start = group[0][1]
        data = source.read_at(max(r[1] + r[2] for r in group) - start, start)
        for r in group:
            yield r, data[r[1] - start : r[1] - start + r[2]]

    for row in rows:
        if group and (row[0] != name or row[1] - (group[-1][1] + group[-1][2]) > gap or row[1] + row[2] - group[0][1] > most):
            yield from fetch()
            group = []
        if row[0] != name:
            if source is not None:
                source.close()
            system, path = opened(row[0])
            source, name = system.open_input_file(path), row[0]
        group.append(row)
    if group:
        yield from fetch()
    if source is not None:
        source.close()
