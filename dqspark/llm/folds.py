"""The split into rows that may be learnt from and rows held out, and sums of matrices over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The remainder that is held out of four, and the one that only calibrates.
HELD_OUT, CALIBRATES = 2, 3


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo four. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of matrices of this shape. parts has rows (block, bytes): so many blocks of rows of a matrix of doubles.

    Each task streams over the rows of its blocks and keeps one sum per block.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw)
                total[block] = total[block] + values if block in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "bytes"])

    rows = parts.repartition("block").mapInArrow(batches, "block int, bytes binary").collect()
    return np.concatenate([np.frombuffer(r["bytes"]) for r in sorted(rows, key=lambda r: r["block"])] or [np.zeros(shape)]).reshape(shape)


def matrix_blocks(matrix: np.ndarray, rows: int = 64) -> pa.RecordBatch:
    pieces = [np.ascontiguousarray(matrix[at : at + rows], float).tobytes() for at in range(0, len(matrix), rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["block", "bytes"])
