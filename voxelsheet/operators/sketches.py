"""Quantile sketches per slice: small, mergeable, with a known rank error.

A sketch of any number of values takes a few kilobytes, so one scan serves all later
questions: percentiles of a slice, of any set of slices, and the window of a drawn
sample. The exact form is :func:`.stacks.exact_percentiles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

K = 800


def rank_error(k: int = K) -> float:
    """The share of ranks by which a quantile is off at most, with 99 % confidence; none up to ``k`` values."""
    return 2.446 / k**0.9433  # fixed values: the published bound of these sketches


def slice_sketches(slices: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, sketch, n: one row per slice. Nulls do not count; partial sketches are merged after the shuffle."""
    whole = F.col(value).cast("bigint")
    return slices.groupBy(*keys).agg(F.kll_sketch_agg_bigint(whole, k).alias("sketch"), F.count(whole).alias("n"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``sketches`` with a column per share: the least value that so many of the values do not exceed; null without values."""
    found = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share)))) for name, share in shares.items()}
    return sketches.withColumns(found)


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """by, sketch, n: the sketch of all slices of a group, without their values."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def window(sketches: DataFrame, low: float, high: float, draws: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """window_min, window_max: means of the low and high quantile over slices, or over drawn ones with repeats.

    Only sketches are read. ``draws`` has a row per draw with the slice's ``keys``.
    """
    bounds = quantiles(sketches, {"low": low, "high": high}).drop("sketch")
    chosen = bounds if draws is None else draws.join(bounds, keys)
    return chosen.agg(F.avg("low").alias("window_min"), F.avg("high").alias("window_max"))
