"""Texts as unit vectors by a model that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

#: Fixed value: what is put before a question, but not before a passage.
QUESTION = "Represent this sentence for searching relevant passages: "

Model = Callable[[Sequence[str]], np.ndarray]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows of zeros stay."""
    vectors = np.asarray(vectors, np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def embedded(texts: DataFrame, id_col: str, text_col: str, load: Callable[[], Model], batch: int = 64) -> DataFrame:
    """(id, embedding): a narrow map; `load` is called once in each task.  Null texts have null vectors."""
    import pyarrow as pa

    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load()
        for rows in batches:
            ids, values = rows.column(0), rows.column(1).to_pylist()
            out: list = [None] * len(values)
            known = [k for k, x in enumerate(values) if x is not None]
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                for k, v in zip(some, unit_rows(model([values[k] for k in some]))):
                    out[k] = v.tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float64()))], [id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<double>")


def question(text: str, model: Model) -> list[float]:
    return unit_rows(model([QUESTION + text]))[0].tolist()
