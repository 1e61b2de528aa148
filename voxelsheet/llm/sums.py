"""Sums of fixed-length vectors that tasks make from their rows.

Each task sends its vector in pieces; pieces are added up in two steps, first
within groups of tasks and then over the groups. The driver gets one vector of
the fixed length, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECE = 1 << 14
_SCHEMA = "piece int, group int, data binary"


def _rows(vector: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
    for piece in range(0, len(vector), PIECE):
        part = vector[piece:piece + PIECE]
        if part.any():
            yield _batch(piece // PIECE, group, part)


def _batch(piece: int, group: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([piece], pa.int32()), pa.array([group], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                           names=["piece", "group", "data"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for piece, group, data in zip(*[batch.column(i) for i in range(3)]):
            key, part = (piece.as_py(), group.as_py()), np.frombuffer(data.as_py(), np.float64)
            if key in total:
                total[key] += part
            else:
                total[key] = part.copy()
    for (piece, group), part in total.items():
        yield _batch(piece, group, part)


def vector_sum(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, groups: int = 32) -> np.ndarray:
    """The sum over all tasks of ``make(batches of the task)``, a float64 vector of ``length``."""

    def work(batches):
        yield from _rows(np.asarray(make(batches), np.float64), TaskContext.get().partitionId() % groups)

    parts = df.mapInArrow(work, _SCHEMA)
    grouped = parts.repartition("piece", "group").mapInArrow(_merge, _SCHEMA)
    whole = grouped.selectExpr("piece", "0 as `group`", "data").repartition("piece").mapInArrow(_merge, _SCHEMA)
    out = np.zeros(length)
    for row in whole.select("piece", "data").toLocalIterator():
        part = np.frombuffer(row.data, np.float64)
        out[row.piece * PIECE: row.piece * PIECE + len(part)] += part
    return out
