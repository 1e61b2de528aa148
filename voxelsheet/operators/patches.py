"""Square patches of an image stack: cutting out and putting back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars
from .blocks import dense_blocks


def _starts(position: Column, patch: int, stride: int) -> Column:
    """Multiples of ``stride`` whose patch covers ``position``."""
    last = scalars.int_div(position, stride)
    first = F.when(position >= patch, scalars.int_div(position - patch, stride) + 1).otherwise(0)
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def patch_cells(pixels: DataFrame, patch: int, stride: int) -> DataFrame:
    """A row per pixel and patch that covers it, with its ``cell`` in the patch.

    Patches start on the stride grid from the top left. A pixel knows its
    patches by arithmetic, so nothing is joined; cells beyond the far edges
    have no row and read as 0.
    """
    rows = pixels.withColumn("patch_y", F.explode(_starts(F.col("py"), patch, stride)))
    rows = rows.withColumn("patch_x", F.explode(_starts(F.col("px"), patch, stride)))
    cell = (F.col("py") - F.col("patch_y")) * patch + F.col("px") - F.col("patch_x")
    return rows.withColumn("cell", cell)


def patch_arrays(cells: DataFrame, keys: list[str], value: str, patch: int) -> DataFrame:
    """Dense ``block`` per patch and channel, at most patch^2 rows per group."""
    return dense_blocks(cells, [*keys, "patch_y", "patch_x"], "cell", value, patch * patch)


def stitch(cells: DataFrame, keys: list[str], value: str, order: list[str], patch: int, width: int, height: int) -> DataFrame:
    """Write patch scores back; patches that do not fit are skipped, later ones win."""
    whole = cells.filter((F.col("patch_y") + patch <= height) & (F.col("patch_x") + patch <= width))
    placed = whole.select(
        *keys, (F.col("patch_y") + scalars.int_div(F.col("cell"), patch)).alias("py"),
        (F.col("patch_x") + F.col("cell") % patch).alias("px"), value, *[F.col(o).alias(f"_{o}") for o in order],
    )
    return placed.groupBy(*keys, "py", "px").agg(F.max_by(value, F.struct(*[f"_{o}" for o in order])).alias(value))


def rescale_to_byte(image: DataFrame, value: str) -> DataFrame:
    """Whole image to 0..255 by its own range (one row of statistics, no join)."""
    low, high = (image.agg(f(value)).scalar() for f in (F.min, F.max))
    share = F.try_divide(F.col(value) - low, high - low)
    return image.withColumn(value, F.coalesce((share * 255).cast("int"), F.lit(0)))


def halves(rows: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Upper half for training, lower half (re-based) for validation."""
    middle = height // 2
    return rows.filter(F.col("py") < middle), rows.filter(F.col("py") >= middle).withColumn("py", F.col("py") - middle)


def shape_check(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Do stack and label cover the same pixels of the same size, at one depth?"""
    size = lambda df, p: df.agg((F.max("py") + 1).alias(f"{p}h"), (F.max("px") + 1).alias(f"{p}w"))
    depth = features.groupBy("image").agg(F.countDistinct("channel").alias("depth")).agg((F.countDistinct("depth") == 1).alias("one_depth"))
    both = size(features, "f").select("fh", "fw", *[size(labels, "l").select(c).scalar().alias(c) for c in ("lh", "lw")],
                                      depth.scalar().alias("one_depth"))
    return both.select(((F.col("fh") == F.col("lh")) & (F.col("fw") == F.col("lw"))).alias("same_size"), "one_depth")


# --- stacks with labels -----------------------------------------------------------------


def channel_first(pictures: DataFrame, layout: str, keys=("image", "py", "px")) -> DataFrame:
    """Pictures as rows image, py, px, channel, v, whatever their layout.

    ``grey`` has a column v (or an index), ``rgb`` the columns r, g, b, ``stack`` a row per channel already.
    """
    if layout == "stack":
        return pictures.select(*keys, "channel", "v")
    if layout == "grey":
        return pictures.select(*keys, F.lit(0).alias("channel"), "v")
    if layout == "rgb":
        channel = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("v")) for n, c in enumerate("rgb")]))
        return pictures.select(*keys, channel.alias("_c")).select(*keys, "_c.*")
    raise ValueError(f"unknown layout {layout!r}; known are grey, rgb and stack")


def stack_faults(features: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per image whose stack and label do not fit: image, fault (``label``, ``size``, ``channels``), and ``depth`` for stacks deeper or flatter than the first.

    Sizes and depths come from one aggregate a side; the two short tables meet by image.
    """
    size = lambda df, p: df.groupBy("image").agg(*[(F.max(c) + 1).alias(f"{p}_{c}") for c in ("py", "px", "channel")])
    both = size(features, "f").join(size(labels, "l"), "image", "left")
    depth = both.agg(F.min_by("f_channel", "image")).scalar()
    fault = (F.when(F.col("l_py").isNull(), "label").when((F.col("f_py") != F.col("l_py")) | (F.col("f_px") != F.col("l_px")), "size")
             .when(~F.col("l_channel").isin(1, 3), "channels").when(F.col("f_channel") != depth, "depth"))
    return both.select("image", fault.alias("fault")).filter("fault is not null")


def labelled_patches(features: DataFrame, labels: DataFrame | None, patch: int, stride: int, depth: int, label_depth: int = 1) -> DataFrame:
    """image, patch_y, patch_x, feature, label: training patches of stacks, channel first.

    Both sides are channel-first rows (:func:`channel_first`). Patches start on the
    stride grid and read 0 beyond the far edges. Features are 16-bit and come out in
    [0, 1]. A patch's feature and label cells lie behind one another in one group of
    at most (depth + label_depth) x patch^2 rows, so both come from one shuffle and
    nothing is joined.
    """
    square = patch * patch
    cells = lambda df, first: patch_cells(df, patch, stride).select(
        "image", "patch_y", "patch_x", (F.col("channel") * square + F.col("cell") + first).alias("cell"), F.col("v").cast("int").alias("v"))
    rows, total = cells(features, 0), depth * square
    if labels is not None:
        rows, total = rows.unionByName(cells(labels, depth * square)), (depth + label_depth) * square
    blocks = dense_blocks(rows, ["image", "patch_y", "patch_x"], "cell", "v", total)
    feature = F.transform(F.slice("block", 1, depth * square), scalars.unit_from_uint16)
    label = F.lit(None).cast("array<int>") if labels is None else F.slice("block", depth * square + 1, label_depth * square)
    return blocks.select("image", "patch_y", "patch_x", feature.alias("feature"), label.alias("label"))
