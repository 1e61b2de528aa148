"""Reading and writing volumes.

Parquet partitioned by volume and slice is the stored form: crops and slice
strides become partition pruning and pushed filters. Raw uint16 slice files are
read by row ranges, so a slice never has to fit into one task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import mounted_path, scratch_path

VOLUME_SCHEMA = "volume_id int, z int, y int, x int, v int"
META_SCHEMA = (
    "height int, max double, min double, name string, slices int, type string, uuid string, voxelsize double, width int"
)


def from_unit_floats(volume: DataFrame) -> DataFrame:
    """[0, 1] floats to uint16, truncated."""
    return volume.withColumn("v", (F.col("v") * 65535).cast("int"))


def write_volume(volume: DataFrame, path: str) -> None:
    """One folder per slice; rows are brought together by slice before the write."""
    clustered = volume.repartition("volume_id", "z")
    clustered.write.mode("overwrite").partitionBy("volume_id", "z").parquet(path)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOLUME_SCHEMA).parquet(path).select("volume_id", "z", "y", "x", "v")


def write_and_read(volume: DataFrame, name: str) -> DataFrame:
    path = scratch_path(volume.sparkSession, name)
    write_volume(volume, path)
    return read_volume(volume.sparkSession, path)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``meta.json`` of a volume folder; a missing file is an error of the scan."""
    return spark.read.schema(META_SCHEMA).json(os.path.join(folder, "meta.json"), multiLine=True)


# --- raw slice files ------------------------------------------------------------------


@dataclass
class _Rows(InputPartition):
    """Rows ``first .. stop-1`` of one slice file."""

    file: str
    z: int
    first: int
    stop: int


def _slice_files(folder: str, suffix: str) -> list[str]:
    """Non-hidden files with the suffix below the folder, sorted by path."""
    found = []
    for root, _, names in os.walk(folder):
        found += [os.path.join(root, n) for n in names if not n.startswith(".") and n.endswith(suffix)]
    return sorted(found)


class SliceReader(DataSourceReader):
    def __init__(self, options):
        self.folder = mounted_path(options["path"])
        self.volume_id = int(options.get("volume_id", "0"))
        self.rows = int(options.get("rows_per_task", "1024"))
        with open(os.path.join(self.folder, "meta.json")) as f:
            meta = json.load(f)
        self.height, self.width, self.slices = meta["height"], meta["width"], meta["slices"]
        box = options.get("bounding_box")
        self.box = [int(v) for v in box.split(",")] if box else [0, 0, 0, self.width, self.height, self.slices]
        self.suffix = options.get("suffix", ".u16")

    def partitions(self):
        x0, y0, z0, x1, y1, z1 = self.box
        files = _slice_files(self.folder, self.suffix)[z0:z1]
        if len(files) != z1 - z0:
            raise ValueError(f"{self.folder}: {len(files)} slice files where {z1 - z0} were declared")
        return [
            _Rows(file, z, first, min(first + self.rows, y1))
            for z, file in enumerate(files) for first in range(y0, y1, self.rows)
        ]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        x0, y0, _, x1, _, _ = self.box
        with open(part.file, "rb") as f:
            f.seek(part.first * self.width * 2)
            rows = np.fromfile(f, "<u2", (part.stop - part.first) * self.width).reshape(-1, self.width)[:, x0:x1]
        height, width = rows.shape
        step = max(1, (1 << 20) // max(width, 1))
        for top in range(0, height, step):
            block = rows[top:top + step]
            n = block.size
            y, x = np.divmod(np.arange(n, dtype="i4"), width)
            columns = [
                np.full(n, self.volume_id, "i4"), np.full(n, part.z, "i4"), (y + part.first + top - y0).astype("i4"),
                x.astype("i4"), block.ravel().astype("i4"),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["volume_id", "z", "y", "x", "v"])


@dataclass
class _Written(WriterCommitMessage):
    files: int


class SliceWriter(DataSourceWriter):
    """Writes rows ``(z, y, cells)``; a slice's rows must be in one task, ordered by y."""

    def __init__(self, options, overwrite):
        self.folder = mounted_path(options["path"])
        self.digits = int(options.get("digits", "5"))
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows) -> _Written:
        current, out, files = None, None, 0
        for z, y, cells in rows:
            if z != current:
                if out is not None:
                    out.close()
                out = open(os.path.join(self.folder, f"{z:0{self.digits}}.u16"), "wb")
                current, files = z, files + 1
            out.seek(y * len(cells))
            out.write(cells)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class SliceSource(DataSource):
    """``spark.read.format("slices")``: raw little-endian uint16 slices with a meta.json.

    Options: path, volume_id, bounding_box ("x0,y0,z0,x1,y1,z1"), rows_per_task,
    suffix. The path must be a file system every executor mounts.
    """

    @classmethod
    def name(cls):
        return "slices"

    def schema(self):
        return VOLUME_SCHEMA

    def reader(self, schema):
        return SliceReader(self.options)

    def writer(self, schema, overwrite):
        return SliceWriter(self.options, overwrite)


@dataclass
class _Band(InputPartition):
    """Rows of bricks ``first .. stop-1`` of the slices of one layer of bricks."""

    files: list[str]
    bz: int
    first: int
    stop: int


class BrickReader(SliceReader):
    """Slices cut into cubes: a task reads the rows of its bands from the slices of a layer and hands out whole bricks."""

    def __init__(self, options):
        super().__init__(options)
        self.edge = int(options.get("edge", "64"))
        self.bands = int(options.get("bands_per_task", "4"))
        self.wide = max(1, (1 << 24) // (2 * self.edge**3))  # bricks at once, some 16 MB

    def partitions(self):
        files = _slice_files(self.folder, self.suffix)
        if len(files) != self.slices:
            raise ValueError(f"{self.folder}: {len(files)} slice files where {self.slices} were declared")
        rows = -(-self.height // self.edge)
        return [_Band(files[z:z + self.edge], z // self.edge, first, min(first + self.bands, rows))
                for z in range(0, self.slices, self.edge) for first in range(0, rows, self.bands)]

    def read(self, part: _Band) -> Iterator[pa.RecordBatch]:
        edge = self.edge
        for by in range(part.first, part.stop):
            for bx in range(0, -(-self.width // edge), self.wide):
                cubes = self._cubes(part.files, by * edge, bx * edge)
                n = len(cubes)
                columns = [np.full(n, v, "i4") for v in (self.volume_id, part.bz, by)] + [np.arange(bx, bx + n, dtype="i4")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([c.tobytes() for c in cubes], pa.binary())], ["volume_id", "bz", "by", "bx", "data"])

    def _cubes(self, files: list[str], y0: int, x0: int) -> np.ndarray:
        """The bricks from (y0, x0) on, side by side; what lies beyond the volume is 0."""
        edge, wide = self.edge, min(self.wide * self.edge, self.width - x0)
        rows = min(edge, self.height - y0)
        across = -(-wide // edge)
        out = np.zeros((edge, edge, across * edge), "<u2")
        for z, file in enumerate(files):
            with open(file, "rb") as f:
                for y in range(rows):
                    f.seek(((y0 + y) * self.width + x0) * 2)
                    out[z, y, :wide] = np.fromfile(f, "<u2", wide)
        return np.ascontiguousarray(out.reshape(edge, edge, across, edge).transpose(2, 0, 1, 3))


class SliceBricks(DataSource):
    """``spark.read.format("slice_bricks")``: raw slices as packed cubes, without a row per voxel and without a shuffle."""

    @classmethod
    def name(cls):
        return "slice_bricks"

    def schema(self):
        return "volume_id int, bz int, by int, bx int, data binary"

    def reader(self, schema):
        return BrickReader(self.options)


def pack_slices(spark: SparkSession, path: str, edge: int = 64, **options) -> DataFrame:
    """``volume_id, bz, by, bx, data`` straight from raw slice files."""
    spark.dataSource.register(SliceBricks)
    reader = spark.read.format("slice_bricks").option("edge", str(edge))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


def write_slices(volume: DataFrame, path: str, shape, meta: dict) -> None:
    """Raw slice files with metadata, absent cells written as 0.

    Rows are packed to bytes per image row (at most ``width`` cells a group);
    slices are spread over tasks by z.
    """
    spark = volume.sparkSession
    spark.dataSource.register(SliceSource)
    depth, height, width = shape
    packed = volume.groupBy("z", "y").agg(F.collect_list(F.struct("x", "v")).alias("cells"))

    def encode(batches):
        for batch in batches:
            bounds = batch.column("cells").offsets.to_numpy()
            values = batch.column("cells").values
            x, v = (values.field(n).to_numpy(zero_copy_only=False) for n in ("x", "v"))
            rows = []
            for start, stop in zip(bounds[:-1], bounds[1:]):
                row = np.zeros(width, "<u2")
                row[x[start:stop]] = v[start:stop]
                rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("z"), batch.column("y"), pa.array(rows, pa.binary())], ["z", "y", "cells"])

    rows = packed.mapInArrow(encode, "z int, y int, cells binary")
    # Every row of every slice exists in the file, so empty rows are added.
    grid = spark.range(depth * height).select(
        F.expr(f"cast(id div {height} as int)").alias("z"), (F.col("id") % height).cast("int").alias("y"), F.unhex(F.lit("00" * 2 * width)).alias("cells")
    )
    whole = grid.unionByName(rows).groupBy("z", "y").agg(F.max("cells").alias("cells"))
    whole.repartition("z").sortWithinPartitions("z", "y").write.format("slices").mode("overwrite").save(path)
    with open(os.path.join(mounted_path(path), "meta.json"), "w") as f:
        json.dump({**meta, "slices": depth, "height": height, "width": width}, f)


def read_slices(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(SliceSource)
    reader = spark.read.format("slices")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)
