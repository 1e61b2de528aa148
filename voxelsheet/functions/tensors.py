"""Expressions on flat blocks: ``ARRAY`` columns indexed ``(z*ny + y)*nx + x``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import unflatten


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A lambda that names an expression computes it again for every element; as
    the only element of an array it is bound to a variable instead.
    """
    return F.transform(F.array(value), body)[0]


def _gather(block: Column, shape, source) -> Column:
    """A block of ``shape`` whose cell (z, y, x) is cell ``source(z, y, x)`` (a flat index) of ``block``.

    Indices are worked out per cell, so the expression has the same size for every shape.
    """
    nz, ny, nx = shape
    places = F.sequence(F.lit(0), F.lit(nz * ny * nx - 1))

    def cell(b):
        def at(i):
            z, y, x = unflatten(i, ny, nx)
            return F.element_at(b, (source(z, y, x) + 1).cast("int"))

        return F.transform(places, at)

    return let(block, cell)


def turn_and_mirror(block: Column, shape, turns: int = 0, mirror: bool = False) -> Column:
    """Quarter turns of every (y, x) plane, then a mirror along x."""
    nz, n, m = shape
    if n != m:
        raise ValueError("planes must be square")

    def source(z, y, x):
        if mirror:
            x = n - 1 - x
        for _ in range(turns % 4):
            y, x = x, n - 1 - y
        return (z * n + y) * n + x

    return _gather(block, shape, source)


def undo_turn_and_mirror(block: Column, shape, turns: int = 0, mirror: bool = False) -> Column:
    flat = turn_and_mirror(block, shape, 0, True) if mirror else block
    return turn_and_mirror(flat, shape, -turns)


def mirror_x(block: Column, shape) -> Column:
    nz, ny, nx = shape
    return _gather(block, shape, lambda z, y, x: (z * ny + y) * nx + (nx - 1 - x))


def mirror_y(block: Column, shape) -> Column:
    nz, ny, nx = shape
    return _gather(block, shape, lambda z, y, x: (z * ny + (ny - 1 - y)) * nx + x)


def central_slices(block: Column, shape) -> tuple[Column, Column, Column]:
    """The middle plane along z, y and x, at index n // 2."""
    nz, ny, nx = shape
    z, y, x = nz // 2, ny // 2, nx // 2
    by_z = F.slice(block, z * ny * nx + 1, ny * nx)
    by_y = _gather(block, (1, nz, nx), lambda _, i, j: (i * ny + y) * nx + j)
    by_x = _gather(block, (1, nz, ny), lambda _, i, j: (i * ny + j) * nx + x)
    return by_z, by_y, by_x


def shared_range(slices) -> tuple[Column, Column]:
    """Smallest and largest value over several planes."""
    low = F.least(*[F.array_min(s) for s in slices])
    high = F.greatest(*[F.array_max(s) for s in slices])
    return low, high


def total(block: Column) -> Column:
    return F.aggregate(block, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def mean(block: Column) -> Column:
    return let(block, lambda b: total(b) / F.size(b))


def standardize(block: Column) -> Column:
    """Zero mean, unit sample deviation; a flat block is only centred."""

    def center(b):
        return let(total(b) / F.size(b), lambda m: F.transform(b, lambda v: v.cast("double") - m))

    def divide(c):
        squares = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)
        deviation = F.sqrt(squares / (F.size(c) - 1))
        return let(F.when(deviation == 0, 1.0).otherwise(deviation), lambda d: F.transform(c, lambda v: v / d))

    return let(let(block, center), divide)


def min_max(block: Column) -> Column:
    """Scale to [0, 1]; null for a flat block."""

    def scale(b):
        span = F.struct(F.array_min(b).cast("double").alias("low"), F.array_max(b).cast("double").alias("high"))
        share = lambda s: F.transform(b, lambda v: F.try_divide(v.cast("double") - s.low, s.high - s.low))
        return let(span, lambda s: F.when(s.high > s.low, share(s)))

    return let(block, scale)


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u + v)
