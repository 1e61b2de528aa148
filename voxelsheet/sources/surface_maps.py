"""Surface-map files: a text header, then float64 records in row order.

Header lines are ``width``, ``height``, ``dim``, ``ordered``, ``type`` and
``version``, comments start with ``#``, and ``<>`` ends it. Records hold
x, y, z and the normal. The reader takes row ranges by seeking; the writer
places each task's pixels at their own offset of one file, so neither side ever
holds a whole map. Both need a file system every executor mounts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import mounted_path

SCHEMA = "face_id int, px int, py int, x double, y double, z double, nx double, ny double, nz double"
NAMES = ["face_id", "px", "py", "x", "y", "z", "nx", "ny", "nz"]
RECORD = 6 * 8


def read_header(path: str) -> dict:
    """Header fields and ``offset``, the first byte of the records."""
    found = {}
    with open(path, "rb") as f:
        for raw in f:
            line = raw.decode("utf-8").strip()
            if line == "<>":
                found["offset"] = f.tell()
                break
            name, _, value = line.partition(": ")
            if not line.startswith("#"):
                found[name] = value.strip()
    if "offset" not in found:
        raise ValueError(f"{path}: the header has no end")
    if found.get("type") != "double":
        raise ValueError(f"{path}: records of type {found.get('type')!r} are not supported")
    if int(found["dim"]) != 6:
        raise ValueError(f"{path}: only maps with 6 values per pixel can be read")
    return {**found, "width": int(found["width"]), "height": int(found["height"]), "dim": 6, "ordered": found.get("ordered") == "true"}


def header_bytes(width: int, height: int, ordered: bool = True, version: str = "1.0") -> bytes:
    flag = "true" if ordered else "false"
    lines = [f"width: {width}", f"height: {height}", "dim: 6", f"ordered: {flag}", "type: double", f"version: {version}", "<>"]
    return ("\n".join(lines) + "\n").encode()


@dataclass
class _RowRange(InputPartition):
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = mounted_path(options["path"])
        self.face = int(options.get("face_id", "0"))
        self.rows = int(options.get("rows_per_task", "256"))
        self.head = read_header(self.path)

    def partitions(self):
        height = self.head["height"]
        return [_RowRange(y, min(y + self.rows, height)) for y in range(0, height, self.rows)]

    def read(self, part: _RowRange) -> Iterator[pa.RecordBatch]:
        width = self.head["width"]
        with open(self.path, "rb") as f:
            f.seek(self.head["offset"] + part.first * width * RECORD)
            step = max(1, (1 << 16) // width)
            for y0 in range(part.first, part.stop, step):
                y1 = min(y0 + step, part.stop)
                values = np.fromfile(f, "<f8", (y1 - y0) * width * 6).reshape(-1, 6)
                if len(values) != (y1 - y0) * width:
                    raise ValueError(f"{self.path}: records end before row {y1}")
                py, px = np.divmod(np.arange(len(values), dtype="i4"), width)
                columns = [np.full(len(values), self.face, "i4"), px, (py + y0).astype("i4"), *values.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], NAMES)


@dataclass
class _Done(WriterCommitMessage):
    pixels: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = mounted_path(options["path"])
        self.width, self.height = int(options["width"]), int(options["height"])
        head = header_bytes(self.width, self.height, options.get("ordered", "true") == "true", options.get("version", "1.0"))
        self.offset = len(head)
        # Written beside the target and moved there on commit.
        self.draft = f"{self.path}.writing"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.draft, "wb") as f:
            f.write(head)
            f.truncate(self.offset + self.width * self.height * RECORD)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        pixels = 0
        with open(self.draft, "r+b") as f:
            for batch in batches:
                column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES[1:]}
                at = column["py"].astype("i8") * self.width + column["px"]
                order = np.argsort(at, kind="stable")
                at = at[order]
                values = np.column_stack([column[n] for n in NAMES[3:]])[order].astype("<f8")
                # Neighbouring pixels go out in one write.
                runs = np.flatnonzero(np.diff(at) != 1) + 1
                for start, stop in zip([0, *runs], [*runs, len(at)]):
                    if stop > start:
                        f.seek(self.offset + int(at[start]) * RECORD)
                        f.write(values[start:stop].tobytes())
                pixels += len(at)
        return _Done(pixels)

    def commit(self, messages):
        os.replace(self.draft, self.path)

    def abort(self, messages):
        pass


class SurfaceMapSource(DataSource):
    """``format("surface_map")``. Options: path, face_id, rows_per_task; width and height to write."""

    @classmethod
    def name(cls):
        return "surface_map"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_surface_map(spark: SparkSession, path: str, face_id: int = 0, rows_per_task: int = 256) -> DataFrame:
    spark.dataSource.register(SurfaceMapSource)
    return spark.read.format("surface_map").option("face_id", str(face_id)).option("rows_per_task", str(rows_per_task)).load(path)


def write_surface_map(surface: DataFrame, path: str, width: int, height: int, version: str = "1.0") -> None:
    """Absent pixels stay all zero, which marks them empty."""
    spark = surface.sparkSession
    spark.dataSource.register(SurfaceMapSource)
    ranged = surface.select(*NAMES).repartitionByRange("py").sortWithinPartitions("py", "px")
    writer = ranged.write.format("surface_map").mode("append")
    writer.option("width", str(width)).option("height", str(height)).option("version", version).save(path)
