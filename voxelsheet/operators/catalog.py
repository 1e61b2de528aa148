"""Run outputs: which predictions exist, and which one counts as of an iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ordering, scalars

SET_TYPES = ("training", "prediction", "validation")


def parse_outputs(files: DataFrame) -> DataFrame:
    """Prediction files of job folders: job, fold, region, iteration and label type.

    ``files`` has ``path`` = ``<job folder>/predictions/<name>``; files in other
    folders are no outputs. A name that does not fit stays, with its parts null
    and ``error`` = ``name``.
    """
    parts = F.split("path", "/")
    rows = files.select("*", F.element_at(parts, -1).alias("name"), F.element_at(parts, -3).alias("job_dir"))
    rows = rows.filter(scalars.is_job_folder(F.col("job_dir")) & F.col("path").contains("/predictions/"))
    name = F.col("name")
    return rows.select(
        *files.columns, "job_dir", scalars.fold_number(F.col("job_dir")).alias("n_from_k_fold"),
        scalars.prediction_file_part(name, 1).alias("region_name"),
        scalars.prediction_file_part(name, 2).alias("iteration_str"),
        scalars.prediction_file_part(name, 3).alias("prediction_type"),
        F.when(scalars.prediction_file_part(name, 1).isNull(), "name").alias("error"),
    )


def with_set_flags(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach source data by region name = stem of the source path.

    An output of a region no source has stays, with ``error`` = ``region``.
    """
    named = sources.withColumn("region_name", scalars.stem(F.col("path"))).drop("path").withColumn("_known", F.lit(True))
    joined = outputs.join(named, "region_name", "left")
    error = F.coalesce("error", F.when(F.col("_known").isNull(), "region"))
    return joined.withColumn("error", error).drop("_known")


def usable(outputs: DataFrame) -> DataFrame:
    return outputs.filter("error is null").drop("error")


def names_in_paths(names: DataFrame, paths: DataFrame, name: str, path: str) -> DataFrame:
    """Pairs where the name occurs anywhere in the path.

    Every substring of a path whose length some name has is looked up in an
    equi join, so pairs that do not match are never formed.
    """
    lengths = names.agg(F.collect_set(F.length(name))).scalar()
    text = F.col(path)
    starts = F.sequence(F.lit(1), F.length(text))
    parts = F.flatten(F.transform(starts, lambda s: F.transform(F.col("_len"), lambda n: F.substring(text, s, n))))
    pieces = paths.withColumn("_len", lengths).withColumn(name, F.explode(F.array_distinct(parts))).drop("_len")
    return pieces.join(names.select(name), name, "left_semi")


def only_sets(outputs: DataFrame, included: list[str] | None) -> DataFrame:
    """Outputs of the chosen set types, each once."""
    if included is None:
        return outputs
    wanted = F.lit(False)
    for s in included:
        wanted = wanted | F.col(s)
    return outputs.filter(wanted).dropDuplicates()


def face_filter(outputs: DataFrame, ppm: str, invert: bool, prediction_type: str, job_dir: str | None = None) -> DataFrame:
    """One face and label type; no job means every job."""
    kept = outputs.filter((F.col("ppm") == ppm) & (F.col("invert_normals") == invert) & (F.col("prediction_type") == prediction_type))
    return kept if job_dir is None else kept.filter(F.col("job_dir") == job_dir)


def latest_as_of(outputs: DataFrame, iteration: Column, by: list[str]) -> DataFrame:
    """Per group the whole row of the latest iteration not after ``iteration``."""
    key = scalars.iteration_key(F.col("iteration_str"))
    rest = [c for c in outputs.columns if c not in by]
    kept = outputs.filter(key <= scalars.iteration_key(iteration))
    top = kept.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(key, *[F.col(c) for c in rest if c == "path"])).alias("top"))
    return top.select(*by, "top.*")


def asof_join(requests: DataFrame, observed: DataFrame, by: list[str], key: str, payload: list[str], bucket_width: int) -> DataFrame:
    """For each request the observed row with the largest key not above its own.

    Both sides go through one running maximum per group, bucketed by key range:
    no request meets more than its own match, and a group of any size is
    spread over its buckets. Adds ``matched_key`` and the payload.
    """
    own = [c for c in requests.columns if c not in by + [key]]
    right = observed.select(*by, key, F.lit(0).alias("_side"), F.struct(F.col(key).alias("matched_key"), *payload).alias("_hit"))
    left = requests.select(*by, key, *own, F.lit(1).alias("_side"))
    rows = right.unionByName(left, allowMissingColumns=True)
    bucket = F.floor(F.col(key) / bucket_width)
    seen = ordering.running(rows, bucket, [key, "_side"], {"_last": ("max", F.col("_hit"))}, by)
    return seen.filter("_side = 1").select(*by, key, *own, "_last.*")


def iteration_list(outputs: DataFrame) -> DataFrame:
    """Distinct iterations per label type with their sort key."""
    return outputs.select("prediction_type", "iteration_str").distinct().withColumn(
        "iteration_key", scalars.iteration_key(F.col("iteration_str"))
    )


def last_iteration(outputs: DataFrame) -> DataFrame:
    key = scalars.iteration_key(F.col("iteration_str"))
    return outputs.groupBy("prediction_type").agg(F.max_by("iteration_str", key).alias("iteration_str"))


def faces(outputs: DataFrame) -> DataFrame:
    """A face is a surface map with its normals kept or turned."""
    return outputs.select("ppm", "invert_normals").distinct()


def first_region(regions: DataFrame, by: list[str], order: str) -> DataFrame:
    rest = [c for c in regions.columns if c not in by]
    return regions.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("f")).select(*by, "f.*")


def first_known(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First non-null value of each column in a fixed order."""
    return rows.groupBy(*by).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    )


def layout(face_heights: DataFrame, width: Column, order: list[str]) -> DataFrame:
    """Row offsets of the faces in a frame (one row per face)."""
    above = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(*order)) - 1
    buffer = F.floor(width / 10)
    rows = face_heights.withColumn("_above", F.coalesce(F.sum("height").over(above), F.lit(0))).withColumn("_n", place)
    return rows.select(*face_heights.columns, (F.col("_above") + (F.col("_n") + 2) * buffer).alias("offset"))


def missing_folds(folds: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Folds without an output folder yet."""
    return folds.join(existing.select(key).distinct(), key, "left_anti")
