"""Columns computed from whole texts, a bounded run of rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .words import slices


def add_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: str,
                limit: int = 1 << 18) -> DataFrame:
    """``df`` with the columns ``fields`` that ``make()`` (called once a task) computes for runs of rows.

    Rows come in runs of about ``limit`` bytes of the column ``text``, so memory does not
    depend on the batch size; a longer text is a run of its own.
    """
    added = StructType.fromDDL(fields)

    def work(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, "text", limit):
                columns = [*part.columns, *compute(part)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *[f.name for f in added.fields]])

    return df.mapInArrow(work, StructType([*df.schema.fields, *added.fields]))


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Short Arrow batches for this session: rows here hold whole texts, and executors hold several batches at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that start at ``first[:-1]``; empty groups give 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out
