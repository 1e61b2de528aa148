"""The log of a training run: report windows, checkpoints, series summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ordering

BUCKET = 65536


def report_windows(log: DataFrame, by: list[str], step: str, batch: str, every: int, bucket_width: int = BUCKET) -> DataFrame:
    """Add ``report``: how many flushes came before the row.

    Values gather until a batch divisible by ``every``; left-overs carry into
    the next epoch.
    """
    flag = F.when(F.col(batch) % every == 0, 1).otherwise(0)
    bucket = F.floor(F.col(step) / bucket_width)
    return ordering.running(log, bucket, [step], {"report": ("sum", flag)}, by, inclusive=False)


def report_values(windows: DataFrame, by: list[str], metric: str, value: str) -> DataFrame:
    """Mean per report and metric, or the sum where the metric's name says so."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    summed = F.col(metric).contains("sum")
    grouped = windows.groupBy(*by, "report", metric).agg(F.sum(v).alias("_s"), F.count(v).alias("_n"))
    return grouped.select(*by, "report", metric, F.when(summed, F.coalesce("_s", F.lit(0.0))).otherwise(F.try_divide("_s", "_n")).alias("value"))


def checkpoints(log: DataFrame, batch: str, every: int) -> DataFrame:
    """Rows at which a run saves its model, validates and predicts."""
    return log.filter(F.col(batch) % every == 0) if every > 0 else log.limit(0)


def trailing_half(rows: DataFrame, by: list[str], order: str, value: str, bucket_width: int = BUCKET) -> DataFrame:
    """Last value of each series, and the range of its second half.

    Series are rows, numbered by bucket, so one may be of any length.
    """
    bucket = F.floor(F.col(order) / bucket_width)
    numbered = ordering.number_rows(rows.select(*by, order, value), bucket, [order], "_rn", by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    late = numbered.join(sizes, by).filter(F.col("_rn") > F.floor(F.col("_n") / 2))
    return late.groupBy(*by).agg(F.max_by(value, "_rn").alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))
