"""Dense arrays from sparse cells.

Spark bounds the Arrow batches these functions see by bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``), so long rows make short batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CELLS_PER_BATCH = 1 << 22
_NUMPY = {"int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


def dense_blocks(rows: DataFrame, keys: list[str], cell: str, value: str, cells: int, present: Column | None = None) -> DataFrame:
    """``keys, block``: one array of ``cells`` values per key, 0 where no row is.

    A group holds at most ``cells`` rows. Rows that are not ``present`` only
    keep their key alive. The fill is one numpy assignment per Arrow batch.
    """
    kind = rows.schema[value].dataType.simpleString()
    entry = F.struct(F.col(cell).cast("int").alias("cell"), F.col(value).alias("v"))
    listed = entry if present is None else F.when(present, entry)
    grouped = rows.groupBy(*keys).agg(F.collect_list(listed).alias("_cells"))

    step = max(1, CELLS_PER_BATCH // cells)

    def fill(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists = batch.column("_cells")
                bounds = lists.offsets.to_numpy()
                first, last = bounds[0], bounds[-1]
                at = lists.values.field("cell").to_numpy(zero_copy_only=False)[first:last]
                values = lists.values.field("v").to_numpy(zero_copy_only=False)[first:last]
                owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                out = np.zeros((batch.num_rows, cells), _NUMPY[kind])
                out[owner, at] = values
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype="i4") * cells)
                blocks = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], blocks], [*keys, "block"])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return grouped.mapInArrow(fill, f"{schema}, block array<{kind}>")
