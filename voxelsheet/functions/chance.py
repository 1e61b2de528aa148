"""Repeatable random numbers.

A draw depends on the row's id and a seed only, never on partitioning, so a
lost executor recomputes the same rows. ``portable`` gives numbers another SQL
engine can reproduce; its linear map is meant for checks only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = 2147483648


def draw(seed: int, *ids: Column | str, portable: bool = False) -> Column:
    """Integer in [0, 2^31)."""
    columns = [F.col(c) if isinstance(c, str) else c for c in ids]
    if portable:
        (key,) = columns
        return (key.cast("bigint") * F.lit(1103515245) + F.lit(seed * 12345 + 67)) % F.lit(SPAN)
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(SPAN))


def uniform(seed: int, *ids: Column | str, portable: bool = False) -> Column:
    """Double in [0, 1)."""
    return draw(seed, *ids, portable=portable) / F.lit(float(SPAN))


def epoch_seed(base_seed: int, epoch: int) -> int:
    """Seed of one training epoch."""
    return epoch + base_seed
