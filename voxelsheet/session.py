"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "voxelsheet", **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and pass the shuffle width with
    ``conf``; AQE coalesces partitions that turn out small and splits the ones
    a hot key makes large.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    built = builder.getOrCreate()
    ship_package(built)
    return built


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = __package__.split(".")[0]
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="voxelsheet-"), name), "zip", root, name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``, else the context's own checkpoint
    folder. Only on one machine (tests) a fresh temporary folder is made; on a
    cluster a missing setting is an error, as executors would write to disks
    the others cannot see.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="voxelsheet-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def mounted_path(path: str) -> str:
    """A path Python can open; files read by position need a mounted file system."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not on a mounted file system; use the Parquet form there")
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one; it holds all staged tables."""
    return f"{shared_dir(spark).rstrip('/')}/voxelsheet-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has staged; results not yet written are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Parquet instead of ``checkpoint()`` where the next reader gains from column
    pruning, filters and file statistics. :func:`clean_up` removes the tables.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
