"""Volumes as stacks of slices: cropping, windows, statistics, overlap and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ordering, scalars
from . import stencils


def crop(voxels: DataFrame, box: tuple[int, int, int, int, int, int]) -> DataFrame:
    """Keep [min, max) on x, y, z and re-base to zero; filters reach the Parquet scan."""
    x0, y0, z0, x1, y1, z1 = box
    kept = voxels.filter(
        (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("z") >= z0) & (F.col("z") < z1)
    )
    return kept.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "z": F.col("z") - z0})


def trim(voxels: DataFrame, first: int, last: int) -> DataFrame:
    """Slices ``first .. last`` inclusive, renumbered from zero."""
    return voxels.filter(F.col("z").between(first, last)).withColumn("z", F.col("z") - first)


def axis_slice(voxels: DataFrame, axis: str, index: int, shape) -> DataFrame:
    """Dense plane ``row, col, v``; a plane outside the volume is all zero."""
    size = dict(zip("zyx", shape))
    rows, cols = (a for a in "zyx" if a != axis)
    plane = voxels.filter(F.col(axis) == index).select(F.col(rows).alias("row"), F.col(cols).alias("col"), "v")
    grid = voxels.sparkSession.range(size[rows] * size[cols]).select(
        scalars.int_div(F.col("id"), size[cols]).alias("row"), (F.col("id") % size[cols]).cast("int").alias("col"), F.lit(0).alias("v")
    )
    return grid.unionByName(plane).groupBy("row", "col").agg(F.max("v").alias("v"))


def eight_bit(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("v", scalars.high_byte(F.col("v")))


def downsample(voxels: DataFrame, scale: int, shape) -> DataFrame:
    """Every ``scale``-th slice, and block means across it, absent cells counted as 0.

    Only whole blocks remain: the new size is the old one floor divided.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError(f"scale factor {scale} is not a power of two")
    _, height, width = shape
    kept = voxels.filter(
        (F.col("z") % scale == 0) & (F.col("y") < height // scale * scale) & (F.col("x") < width // scale * scale)
    )
    block = kept.groupBy("volume_id", *[scalars.int_div(F.col(a), scale).alias(a) for a in "zyx"])
    return block.agg(F.floor(F.sum("v") / (scale * scale)).cast("int").alias("v"))


def downsampled_metadata(meta: DataFrame, scale: int, stamp: Column) -> DataFrame:
    return meta.withColumns({
        "slices": F.ceil(F.col("slices") / scale), "height": F.floor(F.col("height") / scale),
        "width": F.floor(F.col("width") / scale), "voxelsize": F.col("voxelsize") * scale,
        "name": F.concat("name", F.lit(f", downscaled {scale}x")), "uuid": F.date_format(stamp, "yyyyMMddHHmmss"),
    })


# --- extraction ------------------------------------------------------------------


def depths(slices: DataFrame, file: str) -> DataFrame:
    """Declared depth per file and the number of slices in the files before it."""
    per_file = slices.groupBy(file).agg((F.max("z") + 1).alias("depth"))
    earlier = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return per_file.withColumn("before", F.coalesce(F.sum("depth").over(earlier), F.lit(0)))


def slice_numbers(slices: DataFrame, file: str, stride: int) -> DataFrame:
    """Output number and padded name of every kept slice.

    The counter runs on over skipped slices and over files, so it is the file's
    offset plus z: no ordering of slices is needed.
    """
    total = depths(slices, file).agg(F.sum("depth")).scalar()
    numbered = slices.filter(F.col("z") % stride == 0).join(depths(slices, file), file)
    number = (F.col("before") + F.col("z")).cast("bigint")
    return numbered.select(
        *slices.columns, number.alias("number"),
        F.concat(scalars.zero_padded(number, F.length(total.cast("string"))), F.lit(".tif")).alias("combined_name"),
        F.concat(scalars.zero_padded(F.col("z"), F.length(F.col("depth").cast("string"))), F.lit(".tif")).alias("own_name"),
    )


def name_slices(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Padded file names for cells of a stack scan, which brings the numbers; ``sizes`` is a row per stack."""
    total = sizes.agg(F.sum("depth")).scalar()
    named = cells.join(sizes.select("ordinal", "depth"), "ordinal")
    return named.select(
        *cells.columns, F.concat(scalars.zero_padded(F.col("number"), F.length(total.cast("string"))), F.lit(".tif")).alias("combined_name"),
        F.concat(scalars.zero_padded(F.col("z"), F.length(F.col("depth").cast("string"))), F.lit(".tif")).alias("own_name"))


def crop_slices(slabs: DataFrame, min_x=0, width=None, min_y=0, height=None) -> DataFrame:
    """Crop with open upper ends."""
    kept = slabs.filter((F.col("x") >= min_x) & (F.col("y") >= min_y))
    if width is not None:
        kept = kept.filter(F.col("x") < min_x + width)
    if height is not None:
        kept = kept.filter(F.col("y") < min_y + height)
    return kept


def rewindow(slabs: DataFrame, value: str, in_window, out_window=(0.0, 65535.0)) -> DataFrame:
    (low, high), (out_low, out_high) = in_window, out_window
    return slabs.withColumn(value, scalars.rewindow(F.col(value), low, high, out_low, out_high).cast("int"))


# --- statistics -------------------------------------------------------------------


def slice_stats(image: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    v = F.col(value)
    return image.groupBy(*keys).agg(
        F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max"), F.avg(v).alias(f"{prefix}mean")
    )


def raw_and_blurred_stats(image: DataFrame, keys: list[str], value: str, width: int, height: int, sigma: float = 3.0,
                          px: str = "px", py: str = "py") -> DataFrame:
    """Statistics of each slice and of its blur; absent pixels count as 0."""
    return stencils.raw_and_blurred(image, keys, value, width, height, sigma, px, py)


def global_stats(per_slice: DataFrame, prefixes=("", "blurred_")) -> DataFrame:
    """Smallest minimum, largest maximum, mean of means."""
    return per_slice.agg(*[
        f(f"{p}{n}").alias(f"{p}{n}") for p in prefixes for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ])


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, percents: dict[str, int], width: int) -> DataFrame:
    """Linear-interpolated percentiles of whole numbers in hundredths, as whole numbers, without sorting a group.

    Percents are whole, so hundredths are exact. Values are counted, counts are
    summed over value ranges of ``width``, and only the ranges that hold a wanted
    rank are ordered: a task sees at most ``width`` distinct values however many
    rows a slice has.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_b", F.floor(F.col(value) / width))
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("n").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    placed = ranges.withColumns({
        "_below": F.coalesce(F.sum("_size").over(earlier), F.lit(0)), "_total": F.sum("_size").over(everything),
    })
    scaled = {n: (F.col("_total") - 1) * p for n, p in percents.items()}
    ranks = {(n, e): F.call_function("div", r + more, F.lit(100)) for n, r in scaled.items() for e, more in (("low", 0), ("high", 99))}
    wanted = F.lit(False)
    for r in ranks.values():
        wanted = wanted | ((r >= F.col("_below")) & (r < F.col("_below") + F.col("_size")))
    near = counts.join(placed.filter(wanted), [*keys, "_b"])
    upto = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_last", F.col("_below") + F.sum("n").over(upto) - 1)
    holds = lambda r: (r <= F.col("_last")) & (r > F.col("_last") - F.col("n"))
    found = ranked.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        *[F.max(F.when(holds(r), F.col(value))).alias(f"_{n}_{e}") for (n, e), r in ranks.items()],
    )
    return found.select(*keys, *[
        (F.col(f"_{n}_low") * 100 + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (scaled[n] % 100)).cast("bigint").alias(n) for n in percents
    ])


def rounded_mean(hundredths: str, digits: int) -> Column:
    """Mean of whole hundredths, rounded half up to ``digits`` (2 or more) by whole-number arithmetic."""
    total, n = F.sum(F.col(hundredths).cast("decimal(28,0)")), F.count(hundredths).cast("decimal(18,0)")
    unit = 10 ** (digits - 2)
    return F.floor((total * (2 * unit) + n) / (2 * n)).cast("bigint") / F.lit(float(10**digits))


def auto_window(slices: DataFrame, keys: list[str], value: str, low: int, high: int, width: int, draws: DataFrame | None = None,
                digits: int = 4) -> DataFrame:
    """Mean low and high percentile over slices, or over drawn slices (with repeats), to ``digits`` places."""
    per_slice = exact_percentiles(slices, keys, value, {"low": low, "high": high}, width)
    chosen = per_slice if draws is None else draws.join(per_slice, keys)
    return chosen.agg(rounded_mean("low", digits).alias("window_min"), rounded_mean("high", digits).alias("window_max"))


def running_extremes(draws: DataFrame, step: str, low: list[str], high: list[str], bucket_width: int = 65536) -> DataFrame:
    """Global extremes after each processed slice, only where one of them changed."""
    parts = {f"min_{c}": ("min", F.col(c)) for c in low} | {f"max_{c}": ("max", F.col(c)) for c in high}
    before = ordering.running(draws, F.floor(F.col(step) / bucket_width), [step], parts, inclusive=False)
    changed = F.lit(False)
    now = []
    for c in low:
        changed = changed | F.col(f"min_{c}").isNull() | (F.col(c) < F.col(f"min_{c}"))
        now.append(F.least(f"min_{c}", c).alias(f"min_{c}"))
    for c in high:
        changed = changed | F.col(f"max_{c}").isNull() | (F.col(c) > F.col(f"max_{c}"))
        now.append(F.greatest(f"max_{c}", c).alias(f"max_{c}"))
    return before.filter(changed).select(step, *now)


# --- overlap of stacks --------------------------------------------------------------


def slice_windows(images: DataFrame, keys: list[str], count: int, length: int, width: int, keep_last: bool = True) -> DataFrame:
    """``length`` consecutive slices side by side, per starting slice ``start``.

    ``images`` has slice positions ``z`` = 0 .. count-1 and pixels ``px, py``.
    The literal behaviour drops the last window (``keep_last=False``).
    """
    last = count - length if keep_last else count - length - 1
    rows = images.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("start", F.col("z") - F.col("_j"))
    kept = rows.filter(F.col("start").between(0, last))
    return kept.withColumn("px", F.col("px") + F.col("_j") * width).drop("_j", "z")


def binned(image: DataFrame, keys: list[str], value: str, bins: int = 20) -> DataFrame:
    """``value`` replaced by its bin over the image's own value range; a flat image has one bin.

    Images that are compared cover the same pixels, so their ranges are known before they meet.
    """
    spans = image.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    spread = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(value) - F.col("_low")) * bins / (F.col("_high") - F.col("_low"))))
    place = F.least(F.coalesce(spread, F.lit(bins // 2)), F.lit(bins - 1))
    return image.join(spans, keys).withColumn(value, place).drop("_low", "_high")


def mutual_information(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """From the joint histogram of two binned images.

    Histogram cells (at most bins^2 per image) are all that leaves the first
    aggregate.
    """
    joint = pairs.select(*keys, F.col(a).alias("_x"), F.col(b).alias("_y")).groupBy(*keys, "_x", "_y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    sized = joint.select(
        *keys, (F.col("n") / total).alias("p"), (F.sum("n").over(Window.partitionBy(*keys, "_x")) / total).alias("px"),
        (F.sum("n").over(Window.partitionBy(*keys, "_y")) / total).alias("py"),
    )
    return sized.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("score"))


def pearson(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation; null where an image is flat."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return pairs.groupBy(*keys).agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("score"))


COMPARISONS = {"mutual_information": mutual_information, "pearson": pearson}


def overlap_scores(moving: DataFrame, fixed: DataFrame, pair: list[str], function: str, width: int, height: int) -> DataFrame:
    """Score of every moving window against its pair's fixed window, both ``width`` x ``height``.

    ``moving`` has ``pair, start, px, py, v``; ``fixed`` the same without
    ``start``; all pixels must be there. Pearson compares 3x3 medians. The two
    sides meet in one join, after what each needs alone.
    """
    if function not in COMPARISONS:
        raise ValueError(f"unknown comparison {function!r}")
    if function == "pearson":
        moving = stencils.median3(moving, [*pair, "start"], "v", width, height)
        fixed = stencils.median3(fixed, pair, "v", width, height)
    else:
        moving, fixed = binned(moving, [*pair, "start"], "v"), binned(fixed, pair, "v")
    pairs = moving.join(fixed.withColumnRenamed("v", "w"), [*pair, "px", "py"])
    return COMPARISONS[function](pairs, [*pair, "start"], "v", "w")


def best_candidates(scores: DataFrame, pair: list[str], n: int) -> DataFrame:
    """The n best windows per pair, best first (one row per window to rank)."""
    order = Window.partitionBy(*pair).orderBy(F.col("score").desc(), "start")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def merge_slabs(slabs: DataFrame, overlaps: list[int], first_depth: int, reverse: bool = False) -> DataFrame:
    """All of slab 0; of slab k the slices below its overlap index; one numbering.

    The slab list is a parameter, so offsets are constants in the plan.
    """
    taken = [first_depth, *overlaps]
    order = range(len(taken) - 1, -1, -1) if reverse else range(len(taken))
    offset, limit = F.lit(None).cast("int"), F.lit(None).cast("int")
    start = 0
    for k in order:
        offset = F.when(F.col("slab") == k, start).otherwise(offset)
        limit = F.when(F.col("slab") == k, taken[k]).otherwise(limit)
        start += taken[k]
    return slabs.filter(F.col("z") < limit).withColumn("z_merged", F.col("z") + offset)
