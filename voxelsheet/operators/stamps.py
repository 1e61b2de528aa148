"""Writing predictions onto the surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars


def last_write(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One value per key, from the row latest in ``order`` (value breaks full ties).

    ``max_by`` keeps one candidate per key on the map side, so a pixel written
    a million times costs one row in the shuffle.
    """
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def stamp(points: DataFrame, size: int, width: int, height: int, keep: list[str]) -> DataFrame:
    """Repeat a point's prediction over a ``size x size`` square centred by ``size // 2``.

    Pixels off the surface are dropped.
    """
    cell = points.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    placed = cell.select(
        *keep, (F.col("px") - size // 2 + F.col("_cell") % size).alias("px"),
        (F.col("py") - size // 2 + scalars.int_div(F.col("_cell"), size)).alias("py"),
    )
    return placed.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def stamp_patches(patches: DataFrame, patch: tuple[int, int], values: str, width: int, height: int, keep: list[str]) -> DataFrame:
    """Place a flat ``h x w`` patch of predictions around each point."""
    h, w = patch
    cells = patches.select(*keep, "px", "py", F.posexplode(values).alias("_cell", "value"))
    placed = cells.select(
        *keep, "value", (F.col("px") - w // 2 + F.col("_cell") % w).alias("px"),
        (F.col("py") - h // 2 + scalars.int_div(F.col("_cell"), w)).alias("py"),
    )
    return placed.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def prediction_image(points: DataFrame, size: int, width: int, height: int, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Stamped prediction image per ``keys``; later writes win. A new iteration is a new key.

    Writes around the same centre cover the same pixels, so only the last of
    them is stamped: rows are reduced before they are multiplied.
    """
    entry = points.groupBy(*keys, "px", "py").agg(F.max(F.struct(*order, value)).alias("_top"))
    latest = entry.select(*keys, "px", "py", "_top.*")
    stamped = stamp(latest, size, width, height, [*keys, value, *order])
    return last_write(stamped, [*keys, "px", "py"], value, order)
