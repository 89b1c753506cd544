"""Sums over all rows of matrices that numpy makes of Arrow batches: added up in each partition, then row by row in a hash aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded


def summed(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of ``make``'s matrices (``height`` x ``width``, of bounded size) over the batches of ``rows``; zeros without rows. Rows of zeros don't move."""
    bounded(rows.sparkSession)
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(total[some, k]) for k in range(width)]], ["i", *names])

    parts = rows.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((height, width))
    if found.num_rows:
        out[found.column("i").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in names])
    return out
