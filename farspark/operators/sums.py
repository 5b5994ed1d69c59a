"""Sums of small arrays over all rows of a table: tasks add up their batches, the driver gets one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farspark.operators.settle import run_once

#: Rows of a block. A block of a few columns is then small beside a row group and a batch.
BLOCK_ROWS = 1024
#: Rows a kernel gets at most, so that what it makes of them stays in a processor's cache.
KERNEL_ROWS = 8192


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of a batch side by side as doubles, NaN for NULL."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def blocks(df: DataFrame, change: Callable[[np.ndarray], np.ndarray] = lambda rows: rows) -> DataFrame:
    """The rows of the numeric columns of `df`, after `change`, as blocks of doubles, row by row in one binary column.

    A table that many passes read is settled in this form: a block moves as a whole, where a row would be decoded, copied
    and encoded value by value in each pass.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.ascontiguousarray(change(matrix_of(batch)), dtype=float)
                cut = [rows[at : at + BLOCK_ROWS].tobytes() for at in range(0, len(rows), BLOCK_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["block"])

    return df.mapInArrow(pack, "block binary")


def rows_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows of a batch of blocks. Blocks follow each other in memory, so they are one matrix without a copy."""
    column = batch.column(0)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = (int(ends[column.offset + at]) for at in (0, len(column)))
    return np.frombuffer(data, float, (last - first) // 8, first).reshape(-1, width)


def array_sum(of: DataFrame, width: int, kernel: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of `kernel(rows)` over the rows of `blocks`, `width` doubles each. Its `size` is that of a model, not of a table."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch, width)
                for at in range(0, len(rows), KERNEL_ROWS):
                    total += kernel(rows[at : at + KERNEL_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    with run_once(of.sparkSession):
        for row in of.mapInArrow(part, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[row["at"]] = row["value"]
    return out
