"""Neighbourhood operators on images.

Dense grids are worked in tiles: cells are grouped once into square tiles with
a halo of the operator's radius, and numpy does the rest inside a task. A task
never holds an image, and a tile without cells costs one short row or none.
Operators on masks and labels, which are dense already, are separable windows.
``keys`` name the image; ``px`` and ``py`` are its pixel columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = 256
_NUMPY = {"int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


def _touched(c: Column, size: int, radius: int, tile: int) -> Column:
    """Tiles along one axis that have position ``c`` in their core or halo."""
    low = F.greatest(F.lit(0), F.floor((c - radius) / tile))
    high = F.least(F.lit((size - 1) // tile), F.floor((c + radius) / tile))
    return F.sequence(low.cast("int"), high.cast("int"))


def tiles(image: DataFrame, keys: list[str], value: str, width: int, height: int, radius: int = 0, px: str = "px", py: str = "py",
          every: bool = True, tile: int = TILE) -> DataFrame:
    """keys, ty, tx, cells: the cells of each tile and its halo; at most (tile + 2 radius)^2 a row if cells are distinct.

    ``every`` adds the tiles without cells of every image that has any cell.
    """
    cell = F.struct(F.col(py).cast("int").alias("y"), F.col(px).cast("int").alias("x"), F.col(value).alias("v")).alias("cell")
    rows = image.select(*keys, F.col(px), F.col(py), cell)
    rows = rows.withColumn("ty", F.explode(_touched(F.col(py), height, radius, tile)))
    rows = rows.withColumn("tx", F.explode(_touched(F.col(px), width, radius, tile))).select(*keys, "ty", "tx", "cell")
    if every:
        grid = image.select(*keys).distinct()
        for name, size in (("ty", height), ("tx", width)):
            grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit((size - 1) // tile))))
        rows = rows.unionByName(grid, allowMissingColumns=True)
    return rows.groupBy(*keys, "ty", "tx").agg(F.collect_list("cell").alias("cells"))


def _patches(batch: pa.RecordBatch, width: int, height: int, radius: int, tile: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Row, first y and x of the core, and the tile with its halo; beyond the image it is mirrored (d c b a | a b c d)."""
    lists = batch.column("cells")
    ends = lists.offsets.to_numpy()
    y, x, v = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    for row, (ty, tx) in enumerate(zip(batch.column("ty").to_pylist(), batch.column("tx").to_pylist())):
        inside = slice(ends[row], ends[row + 1])
        (y0, y1), (x0, x1) = ((t * tile, min(size, (t + 1) * tile)) for t, size in ((ty, height), (tx, width)))
        low_y, low_x = max(0, y0 - radius), max(0, x0 - radius)
        high_y, high_x = min(height, y1 + radius), min(width, x1 + radius)
        array = np.zeros((high_y - low_y, high_x - low_x), v.dtype)
        np.add.at(array, (y[inside] - low_y, x[inside] - low_x), v[inside])
        missing = ((radius - (y0 - low_y), radius - (high_y - y1)), (radius - (x0 - low_x), radius - (high_x - x1)))
        yield row, y0, x0, np.pad(array, missing, mode="symmetric") if radius else array


def _keys_of(image: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {image.schema[k].dataType.simpleString()}, " for k in keys)


def by_tile(image: DataFrame, keys: list[str], value: str, width: int, height: int, radius: int,
            compute: Callable[[np.ndarray], np.ndarray], px: str = "px", py: str = "py", kind: str | None = None, tile: int = TILE) -> DataFrame:
    """All pixels (keys, py, px, value) of ``compute``, a function from a tile with its halo to the tile."""
    kind = kind or image.schema[value].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for row, y0, x0, patch in _patches(batch, width, height, radius, tile):
                out = compute(patch)
                y, x = np.indices(out.shape)
                own = [batch.column(k).take(pa.array(np.full(out.size, row))) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array((y + y0).ravel().astype("i4")), pa.array((x + x0).ravel().astype("i4")), pa.array(out.ravel().astype(_NUMPY[kind]))],
                    names=[*keys, py, px, value])

    packed = tiles(image, keys, value, width, height, radius, px, py, tile=tile)
    return packed.mapInArrow(work, f"{_keys_of(image, keys)}{py} int, {px} int, {value} {kind}")


def dense(image: DataFrame, keys: list[str], value: str, width: int, height: int, px: str = "px", py: str = "py", tile: int = TILE) -> DataFrame:
    """Add the absent pixels of every image as 0."""
    return by_tile(image, keys, value, width, height, 0, lambda patch: patch, px, py, tile=tile)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _smooth(array: np.ndarray, weights: list[float], axis: int, whole: bool) -> np.ndarray:
    size = array.shape[axis] - len(weights) + 1
    total = sum(w * np.take(array, np.arange(k, k + size), axis) for k, w in enumerate(weights))
    return np.floor(total + 1e-6) if whole else total


def blur_patch(patch: np.ndarray, weights: list[float], whole: bool = True) -> np.ndarray:
    """First down the columns, then along the rows; ``whole`` keeps integers after each pass, as integer images do."""
    return _smooth(_smooth(patch.astype("f8"), weights, 0, whole), weights, 1, whole)


def gaussian_blur(image: DataFrame, keys: list[str], value: str, width: int, height: int, sigma: float = 3.0,
                  whole: bool = True, px: str = "px", py: str = "py", tile: int = TILE) -> DataFrame:
    """Blur of every image; absent pixels count as 0 and are in the result."""
    weights = gaussian_weights(sigma)
    return by_tile(image, keys, value, width, height, len(weights) // 2, lambda patch: blur_patch(patch, weights, whole), px, py,
                   None if whole else "double", tile)


def median3(image: DataFrame, keys: list[str], value: str, width: int, height: int, px: str = "px", py: str = "py", tile: int = TILE) -> DataFrame:
    """3x3 median; mirroring by one pixel repeats the border. Absent pixels count as 0."""

    def middle(patch: np.ndarray) -> np.ndarray:
        rows, columns = patch.shape[0] - 2, patch.shape[1] - 2
        nine = np.stack([patch[i:i + rows, j:j + columns] for i in range(3) for j in range(3)])
        return np.partition(nine, 4, axis=0)[4]

    return by_tile(image, keys, value, width, height, 1, middle, px, py, tile=tile)


def raw_and_blurred(image: DataFrame, keys: list[str], value: str, width: int, height: int, sigma: float = 3.0,
                    px: str = "px", py: str = "py", tile: int = TILE) -> DataFrame:
    """Per image of whole numbers: min, max, mean, and the same of its blur, in one pass over the cells.

    Tiles without cells near them are zero before and after the blur; they are
    counted, not made.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    names = [f"{p}{n}" for p in ("", "blurred_") for n in ("min", "max", "sum")]

    def work(batches):
        for batch in batches:
            rows = []
            for _, _, _, patch in _patches(batch, width, height, radius, tile):
                core = patch[radius:-radius, radius:-radius]
                both = core.astype("i8"), blur_patch(patch, weights).astype("i8")
                rows.append([core.size, *[f(a) for a in both for f in (np.min, np.max, np.sum)]])
            made = np.array(rows, "i8").reshape(-1, len(names) + 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(c) for c in made.T]], names=[*keys, "cells", *names])

    packed = tiles(image, keys, value, width, height, radius, px, py, every=False, tile=tile)
    parts = packed.mapInArrow(work, f"{_keys_of(image, keys)}cells bigint, {', '.join(f'{n} bigint' for n in names)}")
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    total = parts.groupBy(*keys).agg(F.sum("cells").alias("cells"), *[fold[n[-3:]](n).alias(n) for n in names])
    part = F.col("cells") < width * height
    out = []
    for p in ("", "blurred_"):
        out += [F.when(part, F.least(F.col(f"{p}min"), F.lit(0))).otherwise(F.col(f"{p}min")).alias(f"{p}min"),
                F.when(part, F.greatest(F.col(f"{p}max"), F.lit(0))).otherwise(F.col(f"{p}max")).alias(f"{p}max"),
                (F.col(f"{p}sum") / F.lit(float(width * height))).alias(f"{p}mean")]
    return total.select(*keys, *out)


def _line(keys, along, across):
    return Window.partitionBy(*keys, across).orderBy(along)


def find_edges(image: DataFrame, value: str, width: int, height: int, keys=("face_id",)) -> DataFrame:
    """3x3 Laplacian (8 times the pixel minus its neighbours) clipped to 0..255.

    Border pixels are copied. Columns: keys, px, py, value, ``edge``.
    """
    keys = list(keys)
    across, down = _line(keys, "px", "py"), _line(keys, "py", "px")

    def three(c, w):
        return F.coalesce(F.lag(c).over(w), F.lit(0)) + F.col(c) + F.coalesce(F.lead(c).over(w), F.lit(0))

    rows = image.select(*keys, "px", "py", value).withColumn("_row", three(value, across))
    total = rows.withColumn("_sum", three("_row", down))
    border = F.col("px").isin(0, width - 1) | F.col("py").isin(0, height - 1)
    inner = F.least(F.greatest(F.col(value) * 9 - F.col("_sum"), F.lit(0)), F.lit(255))
    return total.select(*keys, "px", "py", value, F.when(border, F.col(value)).otherwise(inner).alias("edge"))


def dilate(image: DataFrame, value: str, radius: int, keys=("face_id",)) -> DataFrame:
    """Largest value in the square of ``radius`` around each pixel."""
    keys = list(keys)
    across = _line(keys, "px", "py").rangeBetween(-radius, radius)
    down = _line(keys, "py", "px").rangeBetween(-radius, radius)
    return image.withColumn(value, F.max(value).over(across)).withColumn(value, F.max(value).over(down))


def ambiguity_overlay(edges: DataFrame) -> DataFrame:
    """Grey label under half-transparent red where the dilated edge is 255.

    The overlay's opacity is 128/255; elsewhere the label shows as it is.
    """
    ink = F.col("ink")
    marked = F.col("edge") == 255
    blend = lambda top: F.floor((F.lit(top) * 128 + ink * 127) / 255 + 0.5).cast("int")
    return edges.select(
        "face_id", "px", "py",
        F.when(marked, blend(255)).otherwise(ink).alias("r"),
        F.when(marked, blend(0)).otherwise(ink).alias("g"),
        F.when(marked, blend(0)).otherwise(ink).alias("b"),
    )
