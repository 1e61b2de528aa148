"""Boxes on surfaces: membership, splitting, painting, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TILE = 256


def in_boxes(pixels: DataFrame, boxes: DataFrame, closed: bool, on: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Pixels with every box that holds them.

    The range condition becomes an equi join on tiles: a box is listed for each
    tile it overlaps, a pixel has one tile. ``closed`` keeps the right and
    bottom edge, as evaluation does; point generation is half open. ``on`` are
    further equal columns, such as the face; with them a null box holds the
    whole surface. Without, null boxes must be filled in first (an error).
    """
    end = 0 if closed else 1
    if not on:
        missing = F.raise_error(F.lit("a box is null: give it the surface's bounds")).cast("int")
        boxes = boxes.withColumn("x0", F.coalesce("x0", missing))
    whole = boxes.filter(F.col("x0").isNull())
    finite = boxes.filter(F.col("x0").isNotNull() & (F.col("x1") - end >= F.col("x0")) & (F.col("y1") - end >= F.col("y0")))
    tiled = finite.withColumn("_ty", F.explode(F.sequence((F.col("y0") / tile).cast("int"), ((F.col("y1") - end) / tile).cast("int"))))
    tiled = tiled.withColumn("_tx", F.explode(F.sequence((F.col("x0") / tile).cast("int"), ((F.col("x1") - end) / tile).cast("int"))))
    keyed = pixels.withColumn("_ty", (F.col("py") / tile).cast("int")).withColumn("_tx", (F.col("px") / tile).cast("int"))
    inside = (
        (F.col("px") >= F.col("x0")) & (F.col("px") <= F.col("x1") - end)
        & (F.col("py") >= F.col("y0")) & (F.col("py") <= F.col("y1") - end)
    )
    hit = keyed.join(tiled, [*on, "_ty", "_tx"]).filter(inside).drop("_ty", "_tx")
    if not on:
        return hit
    return hit.unionByName(pixels.join(whole, list(on)))


def split_grid(boxes: DataFrame, rows: int, columns: int) -> DataFrame:
    """Boxes cut into ``rows x columns`` by floor division; the remainder is dropped."""
    width = F.floor((F.col("x1") - F.col("x0")) / columns)
    height = F.floor((F.col("y1") - F.col("y0")) / rows)
    cell = boxes.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    keep = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return cell.select(
        *keep, "row", "col",
        (F.col("x0") + F.col("col") * width).alias("x0"), (F.col("y0") + F.col("row") * height).alias("y0"),
        (F.col("x0") + (F.col("col") + 1) * width).alias("x1"), (F.col("y0") + (F.col("row") + 1) * height).alias("y1"),
    )


def grid_names(stem: Column, rows: int, columns: int) -> Column:
    return F.concat(stem, F.lit(f"_grid{rows}x{columns}_row"), F.col("row"), F.lit("_col"), F.col("col"), F.lit(".json"))


def merge_on_face(images: DataFrame, rank: str, value: str, keys=("face_id",)) -> DataFrame:
    """Paste region images onto their face in order of ``rank``.

    The first image of a face is taken whole, each later one only inside its
    half-open box (null box: whole). Per pixel the highest rank wins, a maximum
    that combines before the shuffle. Where the list of images is at hand, give
    each row its face's lowest rank as ``first_rank`` and the join is saved.
    """
    keys = list(keys)
    inside = F.col("x0").isNull() | (
        (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    )
    entry = F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))
    # One row per pixel before the short list of first ranks is joined.
    parts = [F.max(F.when(inside, entry)).alias("_top"), F.min(entry).alias("_low")]
    if "first_rank" in images.columns:
        joined = images.groupBy(*keys, "px", "py").agg(*parts, F.min("first_rank").alias("_first"))
    else:
        first = images.groupBy(*keys).agg(F.min(rank).alias("_first"))
        joined = images.groupBy(*keys, "px", "py").agg(*parts).join(first, keys)
    base = F.when(F.col("_low.r") == F.col("_first"), F.col("_low.v"))
    merged = joined.select(*keys, "px", "py", F.coalesce("_top.v", base).alias(value))
    return merged.filter(F.col(value).isNotNull())


def composite(images: DataFrame, order: str, value: str, keys=("face_id",)) -> DataFrame:
    """Only non-zero pixels under a non-zero mask are pasted; later images win."""
    shown = images.filter((F.col(value) > 0) & (F.col("mask") > 0))
    return shown.groupBy(*keys, "px", "py").agg(F.max_by(value, order).alias(value))


def paint(pixels: DataFrame, boxes: DataFrame, order: str, n_colors: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Colour index of the last box over each pixel, times its mask switch."""
    hit = in_boxes(pixels, boxes, closed=False, on=on)
    keys = [c for c in ("face_id",) if c in pixels.columns]
    return hit.groupBy(*keys, "px", "py").agg(
        F.max_by(F.struct(F.col(order), F.col("mask")), order).alias("top")
    ).select(*keys, "px", "py", (F.col(f"top.{order}") % n_colors).alias("color"), F.col("top.mask").alias("mask"))
