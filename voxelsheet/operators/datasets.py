"""Lists of sources: order, sizes, lookup, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordering

VOLUME_SAMPLES = 100_000
BUCKET = 1024


def _bucket(order: str) -> Column:
    return F.floor(F.col(order) / BUCKET)


def source_lengths(sources: DataFrame, points: DataFrame, volume_samples: int = VOLUME_SAMPLES) -> DataFrame:
    """Samples per source: counted points for regions, ``volume_samples`` for volumes."""
    counted = points.groupBy("path").agg(F.count("*").alias("_n"))
    n = F.when(F.col("type") == "volume", volume_samples).otherwise(F.coalesce("_n", F.lit(0)))
    return sources.join(counted, "path", "left").withColumn("n", n.cast("bigint")).drop("_n")


def offsets(lengths: DataFrame, order: str = "source_ord") -> DataFrame:
    """Global index of each source's first sample."""
    return ordering.running(lengths, _bucket(order), [order], {"first": ("sum", F.col("n"))}, inclusive=False)


def locate(indexes: DataFrame, lengths: DataFrame, index: str, order: str = "source_ord", width: int = 65536) -> DataFrame:
    """Source and local index of global indexes; out of range gives no source.

    Sources are listed for every index range of ``width`` they touch, so the
    range condition becomes an equi join and a long source is many short rows.
    """
    placed = offsets(lengths, order).filter("n > 0").select("path", "first", (F.col("first") + F.col("n")).alias("stop"))
    span = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("stop") - 1) / width))
    ranges = placed.withColumn("_b", F.explode(span)).withColumns({
        "_from": F.greatest(F.col("first"), F.col("_b") * width), "_to": F.least(F.col("stop"), (F.col("_b") + 1) * width),
    })
    asked = indexes.withColumn("_b", F.floor(F.col(index) / width))
    inside = (asked[index] >= ranges["_from"]) & (asked[index] < ranges["_to"])
    hit = asked.join(ranges, (asked["_b"] == ranges["_b"]) & inside, "left")
    return hit.select(*[asked[c] for c in indexes.columns], ranges["path"], (asked[index] - ranges["first"]).alias("local_index"))


def nth_region(sources: DataFrame, n: int, order: str = "source_ord") -> DataFrame:
    regions = sources.filter("type = 'region'")
    return ordering.number_rows(regions, _bucket(order), [order], "_rn").filter(F.col("_rn") == n + 1).drop("_rn")


def folds(sources: DataFrame, k: int, order: str = "source_ord", regions_only: bool = True) -> DataFrame:
    """All hold-outs at once: source, fold and the set it is in.

    In fold n the n-th region leaves training and joins validation and
    prediction. ``regions_only=False`` counts every source, as hold-out before
    expansion does.
    """
    pool = sources.filter(F.col("training"))
    countable = pool.filter("type = 'region'") if regions_only else pool
    numbered = ordering.number_rows(countable, _bucket(order), [order], "_rn")
    rest = pool.join(numbered.select("path"), "path", "left_anti").withColumn("_rn", F.lit(0))
    rows = numbered.unionByName(rest).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = F.col("_rn") == F.col("fold") + 1
    sets = F.when(held, F.array(F.lit("validation"), F.lit("prediction"))).otherwise(F.array(F.lit("training")))
    mine = rows.select("path", "fold", F.explode(sets).alias("set_type"))
    others = sources.withColumn("set_type", F.explode(F.array_compact(F.array(
        *[F.when(F.col(s), F.lit(s)) for s in ("validation", "prediction")]
    )))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("path", "fold", "set_type")
    return mine.unionByName(others).distinct()


def union_of_sets(sources: DataFrame) -> DataFrame:
    """Paths of any of the three sets, once each."""
    parts = [sources.filter(s).select("path") for s in ("training", "prediction", "validation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def draw_slices(stacks: DataFrame, n: int, seed: int, portable: bool = False) -> DataFrame:
    """``n`` slices drawn with replacement: step, slab, z.

    ``stacks`` lists files with their depths (slab, depth; one row per file). A
    draw picks a file first and then one of its slices, each by its own random
    number, so a shallow file is drawn as often as a deep one.
    """
    from ..functions import chance

    spark = stacks.sparkSession
    numbered = ordering.number_rows(stacks, F.floor(F.col("slab") / BUCKET), ["slab"], "_rn")
    files = stacks.count()
    draws = spark.range(n).select(F.col("id").alias("step"))
    picked = draws.withColumn("_rn", F.floor(chance.uniform(seed, "step", portable=portable) * files).cast("bigint") + 1)
    placed = picked.join(numbered, "_rn")
    return placed.select("step", "slab", F.floor(chance.uniform(seed + 1, "step", portable=portable) * F.col("depth")).cast("int").alias("z"))
