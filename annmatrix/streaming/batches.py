"""Batches of rows in order, one at a time in the driver's memory."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.shared_scan import source_of


def iter_batches(data: Any, batch_size: int = 4096, layer: str | None = None) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(metadata, values) of batch_size rows at a time, by position.

    Packed rows are sorted and fetched partition by partition; the driver holds a partition and a batch.
    """
    if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size <= 0:
        raise ValueError("batch_size must be a positive integer")
    matrix = source_of(data, "X" if layer is None else f"layers:{layer}").packed()
    names = data.obs.columns
    rows = data.obs.join(matrix.rows.withColumnRenamed("row", "_row"), F.col("_pos") == F.col("_row"), "left").orderBy("_pos")
    kind = np.dtype({"boolean": bool, "tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32}.get(matrix.value_type.simpleString(), np.float64))

    def batches() -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        held: list = []
        for r in rows.toLocalIterator(prefetchPartitions=True):
            held.append(r)
            if len(held) == batch_size:
                yield unpack(held)
                held = []
        if held:
            yield unpack(held)

    def unpack(held: list) -> tuple[pd.DataFrame, np.ndarray]:
        values = np.zeros((len(held), matrix.n_cols), kind)
        for i, r in enumerate(held):
            if r["indices"]:
                values[i, r["indices"]] = r["values"]
        frame = pd.DataFrame([[r[c] for c in names] for r in held], columns=names).set_index("_id")
        return frame, values

    return batches()
