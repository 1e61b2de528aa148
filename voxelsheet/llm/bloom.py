"""A Bloom filter of the values that may occur more than once.

First pass: tasks mark the slots their values fall on, apart from those hit
twice, and send the marks packed by stretch of slots. Merging is a sum that
stops at two, so slots hit once in two tasks count as hit twice. Second pass:
a value all of whose slots were hit twice may be repeated; any other occurs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PROBES = 3
STRETCH_BITS = 17
_SCHEMA = "stretch int, once binary, twice binary"
_U = np.uint64


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` slots of each 64-bit hash, by double hashing."""
    a = values * _U(0x9E3779B97F4A7C15)
    b = (values ^ (values >> _U(31))) * _U(0xD6E8FEB86659FD93) | _U(1)
    return np.stack([(a + _U(k) * b) >> _U(64 - bits) for k in range(PROBES)])


def _marks(bits: int, flush: int = 1 << 20):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            # the slots of one value count once, even where two of them agree
            slots = np.sort(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(_U), bits), axis=0)
            fresh = np.ones(slots.shape, bool)
            fresh[1:] = slots[1:] != slots[:-1]
            held.append(slots[fresh])
            n += held[-1].size
            if n >= flush:
                yield from _pack(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from _pack(np.concatenate(held))

    return work


def _pack(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    slots, counts = np.unique(slots.astype(np.int64), return_counts=True)
    stretch = slots >> STRETCH_BITS
    local = (slots & ((1 << STRETCH_BITS) - 1)).astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1], True]) if len(slots) else np.zeros(1, int)
    rows = [(int(stretch[a]), local[a:b].tobytes(), local[a:b][counts[a:b] > 1].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
    for at in range(0, len(rows), 256):
        s, o, t = zip(*rows[at:at + 256])
        yield pa.record_batch([pa.array(s, pa.int32()), pa.array(o, pa.binary()), pa.array(t, pa.binary())], names=["stretch", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for stretch, once, twice in zip(*[batch.column(i) for i in range(3)]):
            count = seen.setdefault(stretch.as_py(), np.zeros(1 << STRETCH_BITS, np.uint8))
            for marks in (once, twice):
                at = np.frombuffer(marks.as_py(), np.uint32)
                count[at] = np.minimum(count[at] + 1, 2)
    for stretch, count in seen.items():
        yield pa.record_batch([pa.array([stretch], pa.int32()), pa.array([np.packbits(count == 2).tobytes()], pa.binary())], names=["stretch", "bits"])


def maybe_repeated(hashes: DataFrame, max_bits: int = 28):
    """A function from a column of 64-bit hashes to a boolean column: may it occur twice?

    ``hashes`` has one bigint column. The filter has 16 slots a row, a power
    of two, and ``2**max_bits`` at most (32 MiB at 28): that bounds what is
    broadcast. With more rows than it was made for it lets more values
    through, never fewer than the repeated ones.
    """
    rows = hashes.count()
    bits = int(np.clip(np.ceil(np.log2(16 * max(rows, 1))), STRETCH_BITS, max_bits))
    column = hashes.columns[0]
    merged = (hashes.filter(F.col(column).isNotNull()).mapInArrow(_marks(bits), _SCHEMA).repartition("stretch")
              .mapInArrow(_merge, "stretch int, bits binary"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << STRETCH_BITS) // 8
    for row in merged.toLocalIterator():
        table[row.stretch * width:(row.stretch + 1) * width] = np.frombuffer(row.bits, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def probe(values: pd.Series) -> pd.Series:
        slots = _slots(values.to_numpy(np.int64).view(_U), bits)
        found = (shared.value[slots >> _U(3)] >> (_U(7) - (slots & _U(7))).astype(np.uint8)) & 1
        return pd.Series(found.all(axis=0))

    def check(value: Column) -> Column:
        return probe(value)

    return check
