"""Choosing sample points on a surface."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import chance, ordering, scalars
from ..session import materialize
from .gather import BlockOptions
from .stencils import dilate, find_edges


@dataclass(frozen=True)
class PointOptions:
    """Which surface pixels become samples."""

    grid_spacing: int = 4
    specify_inkness: bool | None = None
    undersampling_ink_ratio: float | None = None
    oversampling_ink_ratio: float | None = None
    ambiguous_ink_labels_filter_radius: float | None = None


def default_box(box: Column, width, height) -> Column:
    """The full surface where no box is given."""
    return F.coalesce(box, F.array(F.lit(0), F.lit(0), F.lit(width), F.lit(height)))


def box_is_valid(x0, y0, x1, y1, width, height) -> Column:
    """Editor rule: corners inside the surface, at least one pixel apart."""
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (x0, y0, x1, y1))
    return (
        x0.between(0, width - 2) & (x1 > x0) & (x1 <= width - 1)
        & y0.between(0, height - 2) & (y1 > y0) & (y1 <= height - 1)
    )


def grid_filter(box: tuple[int, int, int, int], spacing: int) -> Column:
    """Every ``spacing``-th pixel from the box corner, half open."""
    x0, y0, x1, y1 = box
    px, py = F.col("px"), F.col("py")
    inside = (px >= x0) & (px < x1) & (py >= y0) & (py < y1)
    return inside & ((px - x0) % spacing == 0) & ((py - y0) % spacing == 0)


def on_surface(raster: DataFrame, radius: int = 1) -> DataFrame:
    """Pixels whose mask square is non-zero throughout.

    Two row-wise and column-wise windows instead of a neighbour join. At the
    far edges the square is cut short; at the near edges (px < r or py < r) the
    pixel fails.
    """
    across = Window.partitionBy("face_id", "py").orderBy("px").rangeBetween(-radius, radius)
    down = Window.partitionBy("face_id", "px").orderBy("py").rangeBetween(-radius, radius)
    low = raster.withColumn("_low", F.min("mask").over(across)).withColumn("_low", F.min("_low").over(down))
    kept = (F.col("_low") != 0) & (F.col("px") >= radius) & (F.col("py") >= radius)
    return low.filter(kept).drop("_low")


def is_ink() -> Column:
    return F.col("ink") != 0


def keep_inkness(raster: DataFrame, wanted: bool | None) -> DataFrame:
    if wanted is None:
        return raster
    return raster.filter(is_ink() if wanted else ~is_ink())


def drop_ambiguous(points: DataFrame, raster: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Drop points near a label edge."""
    edges = dilate(find_edges(raster, "ink", width, height), "edge", int(2 * radius + 1) // 2)
    unclear = edges.filter(F.col("edge") != 0).select("face_id", "px", "py")
    return points.join(unclear, ["face_id", "px", "py"], "left_anti")


def select_points(raster: DataFrame, box, options: PointOptions, width: int, height: int) -> DataFrame:
    """Grid, mask, ink and edge filters in one plan; cheap filters run first."""
    points = on_surface(raster).filter(grid_filter(box, options.grid_spacing))
    points = keep_inkness(points, options.specify_inkness)
    if options.ambiguous_ink_labels_filter_radius is not None:
        points = drop_ambiguous(points, raster, options.ambiguous_ink_labels_filter_radius, width, height)
    if options.undersampling_ink_ratio is not None:
        return undersample(points, options.undersampling_ink_ratio, "point_id")
    if options.oversampling_ink_ratio is not None:
        return oversample(points, options.oversampling_ink_ratio)
    return points


def two_dimensional(block: BlockOptions) -> tuple[BlockOptions, tuple[int, int], int]:
    """Settings for models that predict a plane: the label patch is the block's
    face, the grid spacing its width, and samples are not flipped."""
    _, height, width = block.shape
    return replace(block, augment=False), (height, width), width


# --- class balance -------------------------------------------------------------


def undersample(points: DataFrame, ratio: float, id_column: str, seed: int = 0, portable: bool = False) -> DataFrame:
    """All positives, and int(P * (1-r) / r) negatives drawn with replacement.

    Draws are spread over the positives (the i-th makes its share of the
    total), so they are generated in parallel; a draw picks a negative by its
    row number in hash order. The points are written once, as they are counted,
    numbered and joined.
    """
    points = materialize(points, "points")
    positives, negatives = (points.agg(F.count_if(c)).scalar() for c in (is_ink(), ~is_ink()))
    draws = F.floor(positives * F.lit((1.0 - ratio)) / F.lit(ratio)).cast("bigint")
    numbered = ordering.number_by_draw(
        points.withColumn("_ink", is_ink()), chance.draw(seed, id_column, portable=portable), [id_column], "_rn", by=["_ink"]
    )
    pos, neg = numbered.filter("_ink"), numbered.filter("not _ink")
    share = [F.floor((F.col("_rn") - k) * draws / positives).cast("bigint") for k in (1, 0)]
    plan = pos.select(share[0].alias("_from"), (share[1] - share[0]).alias("_n"))
    picks = ordering.explode_count(plan, F.col("_n"), "_i").select((F.col("_from") + F.col("_i")).alias("draw"))
    wanted = picks.withColumn(
        "_rn", F.floor(chance.uniform(seed + 1, "draw", portable=portable) * negatives).cast("bigint") + 1
    )
    drawn = wanted.join(neg, "_rn").drop("_rn", "_ink")
    kept = pos.withColumn("draw", F.lit(None).cast("bigint")).drop("_rn", "_ink")
    return kept.unionByName(drawn)


def oversample(points: DataFrame, ratio: float) -> DataFrame:
    """Positives repeated max(1, int(need / P)) times, then negatives."""
    points = materialize(points, "points")
    positives, negatives = (points.agg(F.count_if(c)).scalar() for c in (is_ink(), ~is_ink()))
    need = F.floor(negatives * F.lit(ratio) / F.lit(1.0 - ratio))
    reps = F.greatest(F.floor(F.try_divide(need, positives)).cast("bigint"), F.lit(1).cast("bigint"))
    repeated = ordering.explode_count(points.filter(is_ink()), reps, "rep")
    return repeated.unionByName(points.filter(~is_ink()).withColumn("rep", F.lit(0).cast("bigint")))


# --- random points and subsets -----------------------------------------------------


def volume_points(ids: DataFrame, shape, seed: int, portable: bool = False) -> DataFrame:
    """Uniform position and direction for every ``sample_id``."""
    from ..functions import geometry as g

    u = [chance.uniform(seed + k, "sample_id", portable=portable) for k in range(5)]
    direction = g.sphere_direction(u[3], u[4])
    depth, height, width = shape
    return ids.select(
        "*", (u[0] * width).alias("x"), (u[1] * height).alias("y"), (u[2] * depth).alias("z"),
        *[c.alias(f"n{a}") for a, c in zip("xyz", direction)],
    )


def random_subset(samples: DataFrame, id_column: str, size: int, seed: int, portable: bool = False) -> DataFrame:
    """``size`` rows in hash order, with their rank ``rn``; no task sees all rows.

    Rows are counted per bucket of the draw first; only the buckets that hold
    the lowest ``size`` rows are numbered.
    """
    buckets = ordering.draw_buckets(samples)
    drawn = samples.withColumn("_d", chance.draw(seed, id_column, portable=portable))
    bucket = scalars.int_div(F.col("_d"), max(1, chance.SPAN // buckets))
    below, last = 0, -1
    for last, n in drawn.groupBy(bucket.alias("b")).count().orderBy("b").toLocalIterator():
        below += n
        if below >= size:
            break
    low = drawn.filter(bucket <= last)
    numbered = ordering.number_by_draw(low, F.col("_d"), [id_column], buckets=buckets)
    return numbered.filter(F.col("rn") <= size).drop("_d")


def shuffled_batches(samples: DataFrame, id_column: str, batch_size: int, seed: int, portable: bool = False) -> DataFrame:
    """Hash-ordered batches: ``batch`` and ``position`` inside it."""
    numbered = ordering.number_by_draw(samples, chance.draw(seed, id_column, portable=portable), [id_column])
    zero = F.col("rn") - 1
    return numbered.select(
        *samples.columns, F.floor(zero / batch_size).cast("bigint").alias("batch"), (zero % batch_size).alias("position")
    )
