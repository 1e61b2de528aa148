"""Small readers and the sinks for results, samples and run records."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import scalars
from ..operators.manifests import descriptor_text, lines_to_edges, parse_descriptors
from ..session import mounted_path, scratch_path


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with the folder that relative paths are taken from."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", scalars.folder(F.col("path")).alias("folder"), "content")


def _whole_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(folder, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text"))


def read_manifest_edges(spark: SparkSession, folder: str) -> DataFrame:
    return lines_to_edges(_whole_texts(spark, folder, "*.txt"))


def read_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    return parse_descriptors(_whole_texts(spark, folder, "*.json"))


@dataclass
class _Written(WriterCommitMessage):
    files: int


class TextWriter(DataSourceWriter):
    """Each row (name, text) as a file of its own, put under its final name by the task."""

    def __init__(self, options):
        self.folder = mounted_path(options["path"])

    def write(self, rows) -> _Written:
        count = 0
        for name, text in rows:
            target = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            data = (text or "").encode()
            half = f"{target}.{uuid.uuid4().hex}.half"
            with open(half, "wb") as f:
                f.write(data)
            try:
                os.link(half, target)  # fails where a file is, and shows whole files only
            except FileExistsError:
                with open(target, "rb") as f:  # a repeated task finds its own file
                    if f.read() != data:
                        raise
            finally:
                os.unlink(half)
            count += 1
        return _Written(count)

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class TextSink(DataSource):
    """``df.write.format("named_texts")`` for rows (name, text)."""

    @classmethod
    def name(cls):
        return "named_texts"

    def schema(self):
        return "name string, text string"

    def writer(self, schema, overwrite):
        return TextWriter(self.options)


def write_named_texts(texts: DataFrame, path: str) -> None:
    """Write each row (name, text) as the file ``path/name``; names may hold folders and must be distinct.

    The tasks write the files and give them their names, so nothing is done file by file on the
    driver; a file is whole or not there. A name that is taken by another text is an error.
    On a file system that is not mounted the driver has to rename what Spark's writer left.
    """
    spark = texts.sparkSession
    if "://" not in path.removeprefix("file://"):
        spark.dataSource.register(TextSink)
        texts.select("name", "text").write.format("named_texts").mode("append").save(path)
        return
    staged = scratch_path(spark, "texts")
    texts.select(F.col("name"), F.col("text").alias("value")).repartition("name").write.partitionBy("name").option("lineSep", "\n").text(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(staged)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(hadoop.Path(staged + "/name=*/part-*")) or []:
        source = status.getPath()
        target = hadoop.Path(f"{path}/{unquote(source.getParent().getName().removeprefix('name='))}")
        system.mkdirs(target.getParent())
        if not system.rename(source, target):
            raise OSError(f"{target} cannot be written; is it there already?")
    system.delete(folder, True)


def write_descriptors(sources: DataFrame, path: str, name: Column) -> None:
    """One ``<name>.json`` per descriptor."""
    write_named_texts(sources.select(F.concat(name, F.lit(".json")).alias("name"), descriptor_text(sources).alias("text")), path)


def write_manifests(entries: DataFrame, path: str, order: list) -> None:
    """One ``<list>.txt`` per list (columns list, path): one path per line, in order.

    A list is one file, so its lines meet in one row; lists are spread over tasks.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("path").alias("_line")))), lambda e: e["_line"])
    texts = entries.groupBy("list").agg(F.array_join(lines, "\n").alias("text"))
    write_named_texts(texts.select(F.concat("list", F.lit(".txt")).alias("name"), "text"), path)


REGION = "struct<ppm: string, invert_normals: boolean, bounding_box: array<int>>"
SET_TYPES = ("training", "prediction", "validation")


def read_run_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of the ``metadata.json`` of every job folder.

    Columns: job_dir, date, region_name, ppm, invert_normals, bounding_box and a
    flag per set type. A file that is no such record gives one row with ``error``.
    """
    texts = _whole_texts(spark, folder, "metadata.json")
    record = F.from_json("text", f"struct<Date: string, Data: map<string, map<string, {REGION}>>>")
    parsed = texts.select(F.element_at(F.split("path", "/"), -2).alias("job_dir"), record.alias("r"))
    sets = parsed.select("job_dir", F.col("r.Date").alias("date"), F.explode_outer("r.Data").alias("set_type", "regions"))
    rows = sets.select("job_dir", "date", "set_type", F.explode_outer("regions").alias("name", "region"))
    flags = [F.coalesce(F.bool_or(F.col("set_type") == s), F.lit(False)).alias(s) for s in SET_TYPES]
    merged = rows.groupBy("job_dir", F.col("name")).agg(F.max("date").alias("date"), F.min_by("region", "set_type").alias("region"), *flags)
    return merged.select("job_dir", "date", scalars.stem(F.col("name")).alias("region_name"), "region.*", *SET_TYPES,
                         F.when(F.col("date").isNull(), "metadata").alias("error"))


def normalize_raster(raster: DataFrame) -> DataFrame:
    """Labels in their working ranges: RGB and 16-bit texture to [0, 1]."""
    return raster.withColumns({
        **{c: scalars.unit_from_uint8(F.col(c)) for c in "rgb"}, "texture": scalars.unit_from_uint16(F.col("texture")),
    })


def raster_faults(raster: DataFrame) -> DataFrame:
    """Range checks over the whole raster: 8-bit RGB, and a texture that looks 16-bit."""
    top = raster.agg(F.max(F.greatest("r", "g", "b")).alias("rgb"), F.max("texture").alias("texture"))
    return top.select((F.col("rgb") <= 255).alias("rgb_is_8_bit"), F.col("texture").between(255, 65535).alias("texture_is_16_bit"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """A folder per region, iteration and label type; only what was written to exists."""
    keys = ["region", "iteration", "label_type"]
    predictions.repartition(*keys, scalars.int_div(F.col("py"), 256)).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").csv(path, header=True)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Lines of small text files with their numbers: file, n, text."""
    texts = _whole_texts(spark, folder, pattern)
    return texts.select(F.col("path").alias("file"), F.posexplode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("n", "text"))


def read_metric_series(lines: DataFrame) -> DataFrame:
    """Date row / value row pairs (file, line number n, text) to date and values.

    The value row's first five cells are labels. Pairing is by n // 2, so no
    ordering over files is needed.
    """
    pair = scalars.int_div(F.col("n"), 2)
    even = F.col("n") % 2 == 0
    grouped = lines.groupBy("file", pair.alias("pair")).agg(
        F.max(F.when(even, F.split("text", ",")[0])).alias("date"), F.max(F.when(~even, F.col("text"))).alias("cells")
    )
    cells = F.split("cells", ",")
    values = F.slice(cells, 6, F.greatest(F.size(cells) - 5, F.lit(0))).cast("array<double>")
    return grouped.select("file", "pair", F.to_date("date", "yyyy-MM-dd").alias("date"), values.alias("values"))


def write_run_record(record: DataFrame, path: str) -> None:
    """Arguments, data sets, metrics and runtime; written at start and again at the end."""
    record.coalesce(1).write.mode("overwrite").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select("sample_id", "block").write.mode("overwrite").parquet(path)


