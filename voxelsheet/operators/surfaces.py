"""Surface maps as tables: a row per pixel with its point and normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars
from ..functions.ordering import explode_count

VALUES = ("x", "y", "z", "nx", "ny", "nz")

# Colours of label pictures, as red, green, blue.
OFF_SHEET = (0, 51, 160)
SHEET = (210, 180, 140)


def is_mapped() -> Column:
    """Pixels with all six values zero hold no point."""
    used = F.lit(False)
    for c in VALUES:
        used = used | (F.col(c) != 0)
    return used


def translate(surface: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    move = {"x": dx, "y": dy, "z": dz}
    return surface.withColumns({a: F.when(is_mapped(), F.col(a) + d).otherwise(F.col(a)) for a, d in move.items()})


def decimate(surface: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """Pixels at multiples of ``factor``; the size is floor divided."""
    kept = surface.filter((F.col("px") % factor == 0) & (F.col("py") % factor == 0))
    small = kept.withColumns({c: scalars.int_div(F.col(c), factor) for c in ("px", "py")})
    return small.filter((F.col("px") < width // factor) & (F.col("py") < height // factor))


def flat(volumes: DataFrame) -> DataFrame:
    """For every volume (face_id, slices, height, width) a level surface through its middle, with normals along +z."""
    sized = volumes.select("face_id", "width", ((F.col("slices") - 1) / 2.0).alias("z"), (F.col("width").cast("bigint") * F.col("height")).alias("pixels"))
    cells = explode_count(sized, F.col("pixels"), "i")
    px, py = (F.col("i") % F.col("width")).cast("int"), F.call_function("div", F.col("i"), F.col("width")).cast("int")
    return cells.select(
        "face_id", px.alias("px"), py.alias("py"), px.cast("double").alias("x"), py.cast("double").alias("y"),
        "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"),
    )


def from_grey_image(image: DataFrame, value: str, z: float = 0.0) -> DataFrame:
    """Flat surface, mask and labels of a grey image: 0 off the sheet (blue
    0, 51, 160), 1..254 sheet (tan 210, 180, 140), 255 ink (black)."""
    v = F.col(value)
    rgb = [F.when(v == 0, off).when(v < 255, on).otherwise(0).alias(c) for c, off, on in zip("rgb", OFF_SHEET, SHEET)]
    return image.select(
        "px", "py", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.lit(float(z)).alias("z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"),
        F.when(v == 0, 0).otherwise(255).alias("mask"), F.when(v == 255, 255).otherwise(0).alias("ink"),
        *rgb,
    )


def extent(surface: DataFrame, raster: DataFrame, buffer: int) -> DataFrame:
    """Volume box of the masked surface, truncated and widened, and its crop text."""
    masked = surface.join(raster.filter("mask != 0").select("face_id", "px", "py"), ["face_id", "px", "py"])
    box = masked.agg(
        *[(F.min(a).cast("int") - buffer).alias(f"{a}min") for a in "xyz"],
        *[(F.max(a).cast("int") + buffer).alias(f"{a}max") for a in "xyz"],
    )
    size = [F.col(f"{a}max") - F.col(f"{a}min") for a in "xyz"]
    return box.withColumn("crop", F.format_string("%dx%dx%d+%d+%d+%d", *size, *[F.col(f"{a}min") for a in "xyz"]))
