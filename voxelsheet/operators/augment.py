"""Turned and mirrored samples: training flips and test-time averaging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import chance, scalars, tensors

VARIANTS = [(turns, mirror) for turns in range(4) for mirror in (False, True)]


def random_flips(block: Column, shape, seed: int, sample_id: Column, portable: bool = False) -> Column:
    """Mirror along x and y, each with probability one half."""
    bits = chance.draw(seed, sample_id, portable=portable)
    across = F.when(scalars.int_div(bits, 1024) % 2 == 1, tensors.mirror_x(block, shape)).otherwise(block)
    return F.when(scalars.int_div(bits, 2048) % 2 == 1, tensors.mirror_y(across, shape)).otherwise(across)


def average_over_variants(block: Column, shape, score: Callable[[Column], Column]) -> Column:
    """Mean prediction plane over four turns and two mirrors, each undone.

    For scores that are expressions: one projection, no rows added.
    """
    _, ny, nx = shape
    plane = (1, ny, nx)
    total = None
    for turns, mirror in VARIANTS:
        scored = tensors.let(tensors.turn_and_mirror(block, shape, turns, mirror), score)
        undone = tensors.undo_turn_and_mirror(scored, plane, turns, mirror)
        total = undone if total is None else tensors.add_arrays(total, undone)
    return F.transform(total, lambda v: v / float(len(VARIANTS)))


def variant_rows(samples: DataFrame, block: str, shape, averaging: bool = True) -> DataFrame:
    """A row per variant, for models that score rows. Adds ``variant``."""
    variants = VARIANTS if averaging else VARIANTS[:1]
    options = F.array(*[
        F.struct(F.lit(n).alias("variant"), tensors.turn_and_mirror(F.col(block), shape, k, m).alias(block))
        for n, (k, m) in enumerate(variants)
    ])
    rest = [c for c in samples.columns if c != block]
    return samples.select(*rest, F.explode(options).alias("_o")).select(*rest, "_o.*")


def merge_variants(scored: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean of point scores (1x1 predictions need no undoing)."""
    return scored.groupBy(*keys).agg(F.avg(score).alias(score))


def merge_planes(scored: DataFrame, keys: list[str], plane: str, shape: tuple[int, int]) -> DataFrame:
    """Mean of the prediction planes of a sample's variants (column ``variant``), each turned back first."""
    back = F.col(plane)
    for n, (turns, mirror) in enumerate(VARIANTS):
        undone = tensors.undo_turn_and_mirror(F.col(plane), (1, *shape), turns, mirror)
        back = F.when(F.col("variant") == n, undone).otherwise(back)
    turned = scored.select(*keys, back.alias(plane))
    sums = turned.groupBy(*keys).agg(F.collect_list(plane).alias("_planes"))  # a row per variant, eight at most
    total = F.aggregate(F.slice("_planes", 2, len(VARIANTS)), F.get("_planes", 0), tensors.add_arrays)
    return sums.select(*keys, F.transform(total, lambda v: v / F.size("_planes")).alias(plane))


def mosaic(samples: DataFrame, rank: str, block: str, shape, count: int, pad: int = 20) -> DataFrame:
    """Samples with a border of ``pad``, laid out column by column in a square grid.

    Cells only; the border and unused places read as 0.
    """
    side = 1
    while side * side < count:
        side += 1
    nz, ny, nx = shape
    cells = samples.select(F.col(rank).alias("_r"), F.posexplode(block).alias("_i", "v"))
    z, y, x = scalars.unflatten(F.col("_i"), ny, nx)
    return cells.select(
        (z + pad).alias("z"), ((F.col("_r") % side) * (ny + 2 * pad) + pad + y).cast("int").alias("y"),
        (F.floor(F.col("_r") / side) * (nx + 2 * pad) + pad + x).cast("int").alias("x"), "v",
    )
