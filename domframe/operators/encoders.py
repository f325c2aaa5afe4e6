"""Recurrent encoding of number sequences in Arrow batches."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import network
from .network import Lists, Settings

#: Numbers of the sequences that are encoded side by side; a longer one is encoded alone.
CELLS = 200_000


def encoded(rows: DataFrame, key: str, ids: str, s: Settings, params: dict[str, np.ndarray]) -> DataFrame:
    """key and vector of rows(key, ids: array of int): network.text_vectors() of each list; longer ones beside it change nothing."""
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            flat = batch.column(ids).flatten().to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CELLS, side="right")) - 1)
                lists = Lists(first[lo : hi + 1] - first[lo], flat[first[lo] : first[hi]].astype(np.int64))
                vectors = network.text_vectors(network.Tape(held.value, keep=False), s, lists).value
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array(list(vectors), pa.list_(pa.float64()))], names=[key, "vector"])
                lo = hi

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(run, f"{key} {kind}, vector array<double>")
