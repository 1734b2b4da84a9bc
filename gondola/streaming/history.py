"""Gaps and islands over a stream: for every pair the last label and how long it has held, kept as state.

Rows of a pair are taken in order of time, whatever batches they come in; after each split into batches the rows and the
state are those that `windows.islands` gives for all rows at once.  A row that is not later than the last one of its pair
does not change the state and comes back as `late`.  A pair that falls silent is told once, when the watermark has passed
its last row by more than `silent`; it may go on afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["store_id", "category"]
OUT = "store_id long, category string, at timestamp, label string, kind string, change int, island long, run_length long"
HELD = "at timestamp, label string, island long, run_length long"
UNKNOWN = "Unknown"


class Runs(StatefulProcessor):
    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("run", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("at", kind="stable")
        last = self.held.get() if self.held.exists() else None
        out = []
        for at, label in zip(fresh["at"], fresh["label"]):
            if last is not None and at <= pd.Timestamp(last[0]):
                out.append((at, label, "late", None, None, None))
                continue
            before = None if last is None else last[1]
            change = int(before is None or UNKNOWN in (before, label) or before != label)
            island = (0 if last is None else last[2]) + change
            run = 1 if change else last[3] + 1
            last = (at, label, island, run)
            out.append((at, label, "row", change, island, run))
        if last is not None:
            self.held.update((pd.Timestamp(last[0]).to_pydatetime(), *last[1:]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(last[0]).timestamp() * 1000) + self.silent_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, label, island, run = self.held.get()
        yield self._rows(key, [(pd.Timestamp(at), label, "silent", None, island, run)])

    @staticmethod
    def _rows(key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["at", "label", "kind", "change", "island", "run_length"])
        frame.insert(0, "category", key[1])
        frame.insert(0, "store_id", key[0])
        return frame.astype({"change": "Int32", "island": "Int64", "run_length": "Int64"})

    def close(self) -> None:
        pass


def run_lengths(facts: DataFrame, silent_days: int = 92, late: str = "0 seconds") -> DataFrame:
    """(OUT) of a stream of (store_id, category, at, label); kind: row, late or silent."""
    spark = facts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return facts.select(*KEYS, "at", "label").withWatermark("at", late).groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=Runs(silent_days * 86_400_000), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
