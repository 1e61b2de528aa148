"""Several stacks of float slices, one raw file each, read by byte ranges.

A folder holds ``stacks.json``, which lists the stacks in order with their sizes,
and one little-endian float32 file per stack, slices one after the other. The
reader takes over filters on stack, ordinal, z, number, y and x: they and the
stride decide which stacks are opened and which bytes of them are read. Tasks
get about ``bytes_per_task`` each, whether that is many slices or rows of one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    WriterCommitMessage)

from ..session import mounted_path

SCHEMA = "stack string, ordinal int, z int, number bigint, y int, x int, v float"
MANIFEST = "stacks.json"
_WIDTH = 4


@dataclass
class Part(InputPartition):
    """Rows ``y0 .. y1-1`` and cells ``x0 .. x1-1`` of slices ``z0, z0 + step, .. < z1`` of one stack."""

    file: str
    stack: str
    ordinal: int
    before: int
    height: int
    width: int
    z0: int
    z1: int
    step: int
    y0: int
    y1: int
    x0: int
    x1: int

    @property
    def slices(self) -> range:
        return range(self.z0, self.z1, self.step)


class Bounds:
    """What pushed filters leave of one column: a closed range of whole numbers, and perhaps a list of values."""

    def __init__(self):
        self.low, self.high, self.among = None, None, None

    def above(self, value):
        self.low = value if self.low is None else max(self.low, value)

    def below(self, value):
        self.high = value if self.high is None else min(self.high, value)

    def one_of(self, values):
        values = set(values)
        self.among = values if self.among is None else self.among & values

    def holds(self, value) -> bool:
        return (self.low is None or value >= self.low) and (self.high is None or value <= self.high) and (self.among is None or value in self.among)

    def span(self, size: int) -> tuple[int, int]:
        """The half-open part of ``0 .. size`` that the range, or the outermost listed values, leave."""
        low, high = max(0, self.low or 0), size if self.high is None else min(size, self.high + 1)
        if self.among is not None:
            inside = [v for v in self.among if low <= v < high]
            low, high = (min(inside), max(inside) + 1) if inside else (0, 0)
        return low, max(low, high)


def read_range(file, offset: int, count: int) -> np.ndarray:
    """``count`` numbers from the place of number ``offset``."""
    file.seek(offset * _WIDTH)
    return np.fromfile(file, "<f4", count)


class StackReader(DataSourceReader):
    def __init__(self, options):
        self.folder = mounted_path(options["path"])
        self.stride = int(options.get("stride", "1"))
        self.bytes = int(options.get("bytes_per_task", str(32 << 20)))
        if self.stride < 1:
            raise ValueError(f"stride {self.stride} is not positive")
        self.bounds = {c: Bounds() for c in ("stack", "ordinal", "z", "number", "y", "x")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons with whole numbers and stack names; all others are left to Spark."""
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.bounds:
            return False
        name, bounds = f.attribute[0], self.bounds[f.attribute[0]]
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, EqualTo):
            bounds.one_of([f.value])
        elif isinstance(f, In):
            bounds.one_of(f.value)
            return name != "x" and name != "y"  # rows and cells are read as one range, Spark keeps the listed ones
        elif name == "stack":
            return False
        elif isinstance(f, GreaterThan):
            bounds.above(f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            bounds.above(f.value)
        elif isinstance(f, LessThan):
            bounds.below(f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            bounds.below(f.value)
        else:
            return False
        return True

    def partitions(self) -> list[Part]:
        with open(os.path.join(self.folder, MANIFEST)) as f:
            listed = json.load(f)["stacks"]
        parts, before = [], 0
        for ordinal, entry in enumerate(listed):
            if self.bounds["stack"].holds(entry["name"]) and self.bounds["ordinal"].holds(ordinal):
                parts += self._parts(entry, ordinal, before)
            before += entry["depth"]
        return parts

    def _parts(self, entry: dict, ordinal: int, before: int) -> Iterator[Part]:
        (y0, y1), (x0, x1) = self.bounds["y"].span(entry["height"]), self.bounds["x"].span(entry["width"])
        z0, z1 = self.bounds["z"].span(entry["depth"])
        keep = [z for z in range(z0 + -z0 % self.stride, z1, self.stride) if self.bounds["z"].holds(z) and self.bounds["number"].holds(before + z)]
        row = (x1 - x0) * _WIDTH
        if y1 <= y0 or not row:
            return
        rows = max(1, self.bytes // row)
        together = max(1, rows // (y1 - y0))
        runs: list[list[int]] = []
        for z in keep:  # runs of kept slices one stride apart
            if runs and runs[-1][-1] + self.stride == z and len(runs[-1]) < together:
                runs[-1].append(z)
            else:
                runs.append([z])
        for run in runs:
            for top in range(y0, y1, rows):
                yield Part(entry["file"], entry["name"], ordinal, before, entry["height"], entry["width"], run[0], run[-1] + 1, self.stride,
                           top, min(top + rows, y1), x0, x1)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there is no part at all
            return
        wide = part.x1 - part.x0
        step = max(1, (1 << 20) // wide)
        with open(os.path.join(self.folder, part.file), "rb") as f:
            for z in part.slices:
                for top in range(part.y0, part.y1, step):
                    yield self._batch(part, z, top, self._rows(f, part, z, top, min(step, part.y1 - top)))

    def _rows(self, f, part: Part, z: int, top: int, rows: int) -> np.ndarray:
        """A stretch of rows in one read, or row by row where most of their cells are cropped."""
        first, wide = (z * part.height + top) * part.width, part.x1 - part.x0
        if 2 * wide < part.width:
            return np.stack([read_range(f, first + k * part.width + part.x0, wide) for k in range(rows)])
        whole = read_range(f, first + part.x0, (rows - 1) * part.width + wide)
        return np.lib.stride_tricks.as_strided(whole, (rows, wide), (part.width * _WIDTH, _WIDTH), writeable=False)

    @staticmethod
    def _batch(part: Part, z: int, top: int, rows: np.ndarray) -> pa.RecordBatch:
        n = rows.size
        y, x = np.divmod(np.arange(n, dtype="i4"), rows.shape[1])
        columns = [pa.array([part.stack], pa.string()).take(pa.array(np.zeros(n, "i4"))), np.full(n, part.ordinal, "i4"), np.full(n, z, "i4"),
                   np.full(n, part.before + z, "i8"), y + np.int32(top), x + np.int32(part.x0), rows.ravel()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                          ["stack", "ordinal", "z", "number", "y", "x", "v"])


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class StackWriter(DataSourceWriter):
    """Puts rows ``(stack, z, y, cells)`` in their place; several tasks may write one file, a repeated task writes the same again."""

    def __init__(self, options, overwrite):
        self.folder = mounted_path(options["path"])
        self.listed = json.loads(options["stacks"])
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows) -> _Written:
        sizes = {s["name"]: s for s in self.listed}
        name, file, count = None, None, 0
        try:
            for stack, z, y, cells in rows:
                size = sizes[stack]
                if stack != name:
                    if file is not None:
                        os.close(file)
                    name, file = stack, os.open(os.path.join(self.folder, size["file"]), os.O_RDWR | os.O_CREAT)
                    os.ftruncate(file, size["depth"] * size["height"] * size["width"] * _WIDTH)  # absent rows read as 0
                os.pwrite(file, cells, (z * size["height"] + y) * size["width"] * _WIDTH)
                count += 1
        finally:
            if file is not None:
                os.close(file)
        return _Written(count)

    def commit(self, messages):
        for size in self.listed:  # stacks without a single row
            with open(os.path.join(self.folder, size["file"]), "ab") as f:
                f.truncate(size["depth"] * size["height"] * size["width"] * _WIDTH)
        path = os.path.join(self.folder, MANIFEST)
        with open(f"{path}.new", "w") as f:
            json.dump({"stacks": self.listed}, f)
        os.replace(f"{path}.new", path)

    def abort(self, messages):
        pass


class StackSource(DataSource):
    """``spark.read.format("stacks")``; options: path, stride, bytes_per_task. The path must be mounted by every executor."""

    @classmethod
    def name(cls):
        return "stacks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return StackReader(self.options)

    def writer(self, schema, overwrite):
        return StackWriter(self.options, overwrite)


def write_stacks(cells: DataFrame, path: str, sizes: list[tuple[str, int, int, int]]) -> None:
    """``cells`` (stack, z, y, x, v) as one file per stack of ``sizes`` (name, depth, height, width); absent cells are 0.

    An image row (``width`` cells at most) is packed by one group; no task holds a slice.
    """
    spark = cells.sparkSession
    spark.dataSource.register(StackSource)
    listed = [{"name": n, "file": f"{k:05}.f32", "depth": d, "height": h, "width": w} for k, (n, d, h, w) in enumerate(sizes)]
    widths = {s["name"]: s["width"] for s in listed}

    def encode(batches):
        for batch in batches:
            bounds = batch.column("cells").offsets.to_numpy()
            x, v = (batch.column("cells").values.field(n).to_numpy(zero_copy_only=False) for n in ("x", "v"))
            rows = []
            for name, start, stop in zip(batch.column("stack").to_pylist(), bounds[:-1], bounds[1:]):
                row = np.zeros(widths[name], "<f4")
                row[x[start:stop]] = v[start:stop]
                rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("stack", "z", "y")], pa.array(rows, pa.binary())], ["stack", "z", "y", "cells"])

    packed = cells.groupBy("stack", "z", "y").agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("v").cast("float").alias("v"))).alias("cells"))
    rows = packed.select("stack", F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y"), "cells").mapInArrow(encode, "stack string, z int, y int, cells binary")
    rows.sortWithinPartitions("stack", "z", "y").write.format("stacks").option("stacks", json.dumps(listed)).mode("overwrite").save(path)


def read_stacks(spark: SparkSession, path: str, stride: int = 1, **options) -> DataFrame:
    """stack, ordinal, z, number, y, x, v: every ``stride``-th slice of each stack.

    ``number`` runs on over skipped slices and over stacks. Filters on all columns but v are
    taken over by the reader, so a crop is written as a filter.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackSource)
    reader = spark.read.format("stacks").option("stride", str(stride))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, file, depth, height, width, ordinal, before (slices of the stacks ahead): a row per stack of the manifest."""
    with open(os.path.join(mounted_path(path), MANIFEST)) as f:
        listed = json.load(f)["stacks"]
    before, rows = 0, []
    for ordinal, s in enumerate(listed):
        rows.append((s["name"], s["file"], s["depth"], s["height"], s["width"], ordinal, before))
        before += s["depth"]
    return spark.createDataFrame(rows, "name string, file string, depth int, height int, width int, ordinal int, before bigint")
