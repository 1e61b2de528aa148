"""Row numbers and running aggregates over a whole table.

A window without partitions would send every row to one task. Here rows fall
into key ranges (buckets); the window runs inside each bucket, and one short
row per bucket carries the totals of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _carry(df: DataFrame, by: list[str], parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per bucket: each aggregate over all earlier buckets of the same group."""
    per_bucket = df.groupBy(*by, "_bucket").agg(*[_AGG[fn](c).alias(f"_t_{n}") for n, (fn, c) in parts.items()])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        *by, "_bucket", *[_AGG[fn](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (fn, _) in parts.items()]
    )


def running(df: DataFrame, bucket: Column, order: list, parts: dict[str, tuple[str, Column]], by=(),
            inclusive: bool = True) -> DataFrame:
    """Add running aggregates, with or without the row itself.

    ``bucket`` must rise with ``order``. ``parts`` maps a new column to
    ``(sum|min|max, value)``. The cost is one shuffle by bucket; choose buckets
    of some 10^5 rows.
    """
    by = list(by)
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = marked.select("*", *[_AGG[fn](c).over(inside).alias(f"_w_{n}") for n, (fn, c) in parts.items()])
    joined = rows.join(_carry(marked, by, parts), [*by, "_bucket"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_COMBINE[fn](F.col(f"_b_{n}"), F.col(f"_w_{n}")).alias(n) for n, (fn, _) in parts.items()],
    )


def number_rows(df: DataFrame, bucket: Column, order: list, name: str = "rn", by=()) -> DataFrame:
    """One-based row number over the whole table (or over each ``by`` group)."""
    by = list(by)
    marked = df.withColumn("_bucket", bucket)
    rows = marked.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    carry = _carry(marked, by, {"n": ("sum", F.lit(1))})
    joined = rows.join(carry, [*by, "_bucket"], "left")
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_rn") + F.coalesce("_b_n", F.lit(0))).alias(name))


def draw_buckets(df: DataFrame, rows: int = 1 << 17) -> int:
    """Buckets of a uniform draw that hold about ``rows`` rows each, from the counted size."""
    return max(1, -(-df.count() // rows))


def number_by_draw(df: DataFrame, draw: Column, ties: list, name: str = "rn", by=(), buckets: int | None = None) -> DataFrame:
    """Row number in the order of a uniform draw from [0, 2^31), in buckets of a counted number."""
    width = max(1, 2147483648 // (buckets or draw_buckets(df)))
    marked = df.withColumn("_draw", draw)
    bucket = (F.col("_draw") / width).cast("int")
    return number_rows(marked, bucket, ["_draw", *ties], name, by).drop("_draw")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows over the shuffle width ahead of a step that multiplies them.

    The number is explicit, so AQE does not fold short but productive
    partitions back into one task.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def explode_count(df: DataFrame, count: Column, name: str, chunk: int = 65536) -> DataFrame:
    """Rows ``0 .. count-1`` per input row; long ranges spread over tasks first."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(chunk).cast("bigint")))
    chunks = df.filter(count > 0).withColumn("_n", count).withColumn("_s", start.alias("_s"))
    spread = chunks.repartition(F.xxhash64("_s", *df.columns))
    stop = F.least(F.col("_s") + (chunk - 1), F.col("_n") - 1)
    return spread.withColumn(name, F.explode(F.sequence(F.col("_s"), stop))).drop("_s", "_n")
