"""Brick form of the gather: one packed cube of voxels instead of a row per voxel.

A point's rotated block touches a few bricks (at most 27 when a side of its
bounds spans three). Points are collected in chunks per brick, each chunk meets
its brick once, and numpy reads all cells the brick owns, for all points of a chunk
at once. Shuffled are small point rows, bricks once per chunk, and packed cell
values; never a row per cell. Blocks may differ in shape from point to point.
Samples, requests with radii, boxes along the axes and oblique planes are all
placed points: a centre, a basis, and numbers of cells.

A brick that a third of all points touch gets many chunks: their number follows
the counted points and cells, and each chunk meets a copy of the brick of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as g, scalars
from ..functions.ordering import spread
from ..functions.scalars import int_div
from ..session import materialize
from .gather import BlockOptions, place_centers

CHUNK_POINTS = 4096
CHUNK_CELLS = 1 << 27
CELLS_PER_BATCH = 1 << 21
BYTES_PER_BATCH = 1 << 23
BRICK = ["volume_id", "bz", "by", "bx"]
_BASIS = [f"b{a}{b}" for a in "xyz" for b in "xyz"]
_SHAPE = ["nz", "ny", "nx"]


def pack_bricks(voxels: DataFrame, edge: int = 64) -> DataFrame:
    """voxels to ``volume_id, bz, by, bx, data``; a group is one brick, at most edge^3 rows."""
    cell = ((F.col("z") % edge) * edge + F.col("y") % edge) * edge + F.col("x") % edge
    grouped = voxels.groupBy(
        "volume_id", *[int_div(F.col(a), edge).alias(f"b{a}") for a in "zyx"]
    ).agg(F.collect_list(F.struct(cell.cast("int").alias("cell"), F.col("v").cast("int").alias("v"))).alias("cells"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            bounds = cells.offsets.to_numpy()
            at = cells.values.field("cell").to_numpy(zero_copy_only=False)
            values = cells.values.field("v").to_numpy(zero_copy_only=False)
            packed = []
            for start, stop in zip(bounds[:-1], bounds[1:]):
                cube = np.zeros(edge**3, "<u2")
                cube[at[start:stop]] = values[start:stop]
                packed.append(cube.tobytes())
            columns = [batch.column(c) for c in ("volume_id", "bz", "by", "bx")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(packed, pa.binary())], ["volume_id", "bz", "by", "bx", "data"]
            )

    return grouped.mapInArrow(encode, "volume_id int, bz int, by int, bx int, data binary")


def write_bricks(bricks: DataFrame, path: str) -> None:
    """A folder per row of bricks (volume, bz, by), in order of bx; a row of 64-voxel bricks of a wide scan is some 100 MB."""
    rows = ["volume_id", "bz", "by"]
    bricks.repartition(*rows).sortWithinPartitions(*BRICK).write.mode("overwrite").partitionBy(*rows).parquet(path)


def read_bricks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("volume_id int, bz int, by int, bx int, data binary").parquet(path).select(*BRICK, "data")


def unpack_bricks(bricks: DataFrame, edge: int = 64) -> DataFrame:
    """Non-zero voxels of packed bricks."""

    def decode(batches):
        for batch in batches:
            corners = {c: batch.column(c).to_numpy() for c in ("volume_id", "bz", "by", "bx")}
            for k, data in enumerate(batch.column("data")):
                cube = np.frombuffer(data.as_buffer(), "<u2")
                at = np.flatnonzero(cube)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, corners["volume_id"][k], "i4")),
                        pa.array((corners["bz"][k] * edge + at // (edge * edge)).astype("i4")),
                        pa.array((corners["by"][k] * edge + at // edge % edge).astype("i4")),
                        pa.array((corners["bx"][k] * edge + at % edge).astype("i4")),
                        pa.array(cube[at].astype("i4")),
                    ],
                    ["volume_id", "z", "y", "x", "v"],
                )

    return bricks.mapInArrow(decode, "volume_id int, z int, y int, x int, v int")


@dataclass(frozen=True)
class Reads:
    """How positions follow from a block's cells, and voxels from positions.

    ``offsets`` along an axis of n cells: ``sample`` is centred as samples are, ``radius``
    runs from -(n - 1) / 2, ``corner`` from 0. Positions plus ``rounding`` are truncated.
    ``clamp`` reads the nearest voxel inside for positions outside the volume, which
    otherwise read 0.
    """

    ratio: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offsets: str = "sample"
    rounding: float = 0.5
    clamp: bool = False
    interpolated: bool = False
    compat_corner: bool = False

    @classmethod
    def of(cls, options: BlockOptions) -> Reads:
        return cls(options.ratio, interpolated=options.method == "interpolated", compat_corner=options.compat_corner)

    def along(self, n: int) -> np.ndarray:
        if self.offsets == "sample":
            return np.trunc(np.arange(n) - (n - 1) / 2.0 + 0.5)
        return np.arange(n) - (n - 1) // 2 * (self.offsets == "radius") * 1.0

    def ends(self, n: Column) -> tuple[Column, Column]:
        """Least and greatest offset of n cells."""
        if self.offsets == "sample":
            return g.truncate(F.lit(0.5) - (n - 1) / 2.0), g.truncate((n - 1) / 2.0 + 0.5)
        first = -scalars.int_div(n - 1, 2) if self.offsets == "radius" else F.lit(0)
        return first, first + n - 1

    @property
    def part(self) -> str:
        """Parts hold values for nearest reads, shares of sums for trilinear ones."""
        return "<f8" if self.interpolated else "<u2"


POINT = ["point_id", "volume_id", "cx", "cy", "cz", *_BASIS, *_SHAPE]


def touched_bricks(points: DataFrame, reads: Reads, shape, edge: int) -> DataFrame:
    """A row per point and brick its block may read.

    The bounds of a turned box follow axis by axis from the extreme offsets.
    Truncation maps positions above -1 to voxel 0, so the low end clamps.
    A block outside the volume, and one whose column ``reads`` is false, gets brick -1, which holds nothing.
    """
    ends = {a: reads.ends(F.col(f"n{a}")) for a in "zyx"}
    ratio = dict(zip("zyx", reads.ratio))
    out = points
    for axis, size in zip("zyx", shape):
        low = high = F.col(f"c{axis}")
        for name in "xyz":
            b = F.col(f"b{name}{axis}") * ratio[name]
            low = low + F.least(b * ends[name][0], b * ends[name][1])
            high = high + F.greatest(b * ends[name][0], b * ends[name][1])
        first, last = g.truncate(low + (reads.rounding - 0.5) - 1e-6), g.truncate(high + (1.0 if reads.interpolated else reads.rounding) + 1e-6)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(size - 1))
        if reads.clamp:
            first, last = F.least(first, F.lit(size - 1)), F.greatest(last, F.lit(0))
            inside = F.lit(True)
        else:
            inside = (high > -2.1) & (last >= first)
        if "reads" in points.columns:
            inside = inside & F.col("reads")
        reach = F.when(inside, F.sequence(scalars.int_div(first, edge), scalars.int_div(last, edge)))
        out = out.withColumn(f"b{axis}", F.explode(F.coalesce(reach, F.array(F.lit(-1)))))
    return out


class _Cube:
    """Cells of points with blocks of one shape that one brick owns, all points at once.

    A block is looked at line by line along its last axis. Where a line enters and leaves the brick
    follows from its step, so only the cells between, with a margin, get a position.
    ``cell`` is their place among all cells of the points' blocks.
    """

    def __init__(self, cube, corner: dict, reads: Reads, shape, edge: int, points: dict, cells: tuple[int, int, int]):
        self.cube, self.corner, self.reads, self.edge, self.points, self.cells = cube, corner, reads, edge, points, cells
        self.size = dict(zip("zyx", shape))
        self.top = {a: min(edge, self.size[a] - corner[a]) for a in "zyx"}
        nz, ny, nx = cells
        offsets = reads.along(nx)
        first, last = 0.0, float(nx)
        for a in "zyx":
            across = (self._step(a, "y")[:, None, :] + self._step(a, "z")[:, :, None]) + points[f"c{a}"][:, None, None]
            low = -np.inf if reads.clamp and corner[a] == 0 else corner[a] - 2.5
            high = np.inf if reads.clamp and corner[a] + self.top[a] == self.size[a] else corner[a] + self.top[a] + 1.5
            step = points[f"bx{a}"] * reads.ratio[2]
            still = np.abs(step) * nx < 1e-3  # such lines stay within the margin
            back = (1.0 / np.where(still, 1.0, step))[:, None, None]
            enter, leave = (low - across) * back, (high - across) * back
            enter, leave = np.minimum(enter, leave), np.maximum(enter, leave)
            if still.any():
                within = (across[still] >= low) & (across[still] <= high)
                enter[still], leave[still] = np.where(within, -np.inf, np.inf), np.where(within, np.inf, -np.inf)
            # offsets are k + offsets[0], or one less above the middle of an odd block
            first, last = np.maximum(first, enter - offsets[0]), np.minimum(last, leave - offsets[0] + 2)
        first, last = np.ceil(np.minimum(first, nx)).astype(int), np.floor(np.maximum(last, 0)).astype(int)
        point, z, y = self.line = np.nonzero(last > first)
        first = first[self.line]
        self.counts = last[self.line] - first
        first = first - (np.cumsum(self.counts) - self.counts)
        each = np.arange(self.counts.sum())
        self.along = np.repeat(point * nx + first, self.counts) + each
        self.cell = np.repeat(((point * nz + z) * ny + y) * nx + first, self.counts) + each

    def _step(self, axis: str, name: str) -> np.ndarray:
        """What each cell along a block axis adds to the position along a volume axis (points x cells)."""
        k = "zyx".index(name)
        return self.reads.along(self.cells[k])[None, :] * self.points[f"b{name}{axis}"][:, None] * self.reads.ratio[k]

    def position(self, axis: str) -> np.ndarray:
        """Volume positions of the cells along one axis.

        The grid is separable, so parts are added up line by line; additions run in
        the same order as in geometry.sample_position, which keeps both forms equal
        to the last bit.
        """
        point, z, y = self.line
        row = (self.points[f"c{axis}"][:, None] + self._step(axis, "x")).ravel()[self.along]
        plane = row + np.repeat(self._step(axis, "y")[point, y], self.counts)
        return plane + np.repeat(self._step(axis, "z")[point, z], self.counts)

    def local(self, axis: str, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of voxel indexes in the cube, and which of them lie in it.

        Seen as unsigned, indexes below the brick wrap to large numbers, so one
        comparison bounds both sides.
        """
        if self.reads.clamp:
            index = np.clip(index, 0, self.size[axis] - 1)
        place = (index - np.int32(self.corner[axis])).view("u4")
        return place, place < self.top[axis]

    def _place(self, z, y, x, at):
        edge = np.uint32(self.edge)
        return (z[at] * edge + y[at]) * edge + x[at]

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells that are owned, in order, and their values."""
        at = {a: self.local(a, (self.position(a) + self.reads.rounding).astype("i4")) for a in "zyx"}
        owned = at["z"][1] & at["y"][1] & at["x"][1]
        return self.cell[owned], self.cube[self._place(at["z"][0], at["y"][0], at["x"][0], owned)]

    def trilinear(self) -> tuple[np.ndarray, np.ndarray]:
        """This brick's share of the eight-corner sums; each axis and side is looked at once, not once a corner."""
        side, share = {}, {}
        for a in "zyx":
            at = self.position(a)
            base = at.astype("i4")
            part = at - base
            side[a] = [self.local(a, base + np.int32(bit)) for bit in (0, 1)]
            share[a] = [1.0 - part, part]
        total, any_owned = np.zeros(part.shape), np.zeros(part.shape, bool)
        for bx, by, bz in np.ndindex(2, 2, 2):
            row = 0 if self.reads.compat_corner and bx == 1 and bz == 0 else by
            (z, in_z), (y, in_y), (x, in_x) = side["z"][bz], side["y"][row], side["x"][bx]
            owned = in_z & in_y & in_x
            weight = share["x"][bx][owned] * share["y"][by][owned] * share["z"][bz][owned]
            total[owned] += weight * self.cube[self._place(z, y, x, owned)]
            any_owned |= owned
        return self.cell[any_owned], total[any_owned]


def _runs(points: pa.StructArray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """Points of one shape at a time, as many as make up a batch of cells."""
    sizes = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in _SHAPE])
    kinds, owner = np.unique(sizes, axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        rows = np.flatnonzero(owner.ravel() == k)
        step = max(1, CELLS_PER_BATCH // int(np.prod(kind)))
        for start in range(0, len(rows), step):
            yield tuple(int(n) for n in kind), rows[start:start + step]


def _read_cells(reads: Reads, shape, edge: int, summary: bool):
    size = dict(zip("zyx", shape))

    def rows_of(cube, points, corner):
        columns = {c: points.field(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy", "cz", *_BASIS)}
        ids = points.field("point_id")
        inside = cube is not None and all(0 <= corner[a] < size[a] for a in "zyx")
        for kind, rows in _runs(points):
            cells = int(np.prod(kind))
            if inside:
                one = _Cube(cube, corner, reads, shape, edge, {c: v[rows] for c, v in columns.items()}, kind)
                owned, values = one.trilinear() if reads.interpolated else one.nearest()
            else:
                owned, values = np.zeros(0, int), np.zeros(0, reads.part)
            ends = np.searchsorted(owned, np.arange(len(rows) + 1) * cells)
            if summary:
                total = np.r_[0, np.cumsum(values.astype("i8"))]
                some, most = np.flatnonzero(np.diff(ends)), np.zeros(len(rows), "i4")
                if len(some):
                    most[some] = np.maximum.reduceat(values, ends[some])
                made = [pa.array(np.full(len(rows), cells, "i8")), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), pa.array(most, pa.int32())]
                names = ["point_id", "n", "sum_v", "max_v"]
            else:
                whole = np.zeros(len(rows) * cells, bool)
                whole[owned] = True
                masks = np.packbits(whole.reshape(len(rows), cells), axis=1)
                made = [pa.array([m.tobytes() for m in masks], pa.binary()), pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                        *[pa.array(np.full(len(rows), n, "i4")) for n in kind]]
                names = ["point_id", "mask", "cells", *_SHAPE]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *made], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i]
                cube = np.frombuffer(data.as_buffer(), "<u2") if data.is_valid else None
                corner = {a: batch.column(f"b{a}")[i].as_py() * edge for a in "zyx"}
                yield from rows_of(cube, batch.column("points")[i].values, corner)

    return read


def _met(points: DataFrame, bricks: DataFrame, reads: Reads, shape, edge: int) -> DataFrame:
    """Chunks of points with the brick they may read."""
    # listed once: the list is counted, joined, and says which files of bricks are wanted
    kept = [*POINT, "reads"] if "reads" in points.columns else POINT
    touched = materialize(touched_bricks(points.select(*kept), reads, shape, edge).drop("reads"), "touched")
    cells = F.sum(F.col("nz").cast("bigint") * F.col("ny") * F.col("nx"))
    counts = touched.groupBy(*BRICK).agg(F.ceil(F.greatest(F.count("*") / CHUNK_POINTS, cells / CHUNK_CELLS)).alias("chunks"))
    salted = touched.join(counts, BRICK).withColumn("chunk", F.pmod(F.xxhash64("point_id"), F.col("chunks")))
    chunks = spread(salted, *BRICK, "chunk").groupBy(*BRICK, "chunk").agg(
        F.collect_list(F.struct("point_id", "cx", "cy", "cz", *_BASIS, *_SHAPE)).alias("points"))
    # a copy of the brick for each of its chunks: met by brick alone, all points of a brick would be one task's
    copies = wanted(bricks, touched).join(counts, BRICK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    return chunks.join(copies.select(*BRICK, "chunk", "data"), [*BRICK, "chunk"], "left")


def wanted(bricks: DataFrame, touched: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Bricks in rows of bricks that some point touches.

    Stored bricks are in folders by volume, bz and by (:func:`write_bricks`), so the list of rows
    becomes a filter on folders while the query runs: what no point touches is not opened.
    The list, 12 bytes a row of bricks, is counted first; beyond ``most`` rows nothing is pruned.
    """
    rows = touched.filter("bz >= 0 and by >= 0").select("volume_id", "bz", "by").distinct()
    if rows.count() > most:
        return bricks
    return bricks.join(F.broadcast(rows), ["volume_id", "bz", "by"], "left_semi")


def _with_shape(points: DataFrame, options: BlockOptions, portable: bool) -> DataFrame:
    placed = place_centers(points, options, ["point_id"], portable)
    return placed.withColumns({c: F.lit(n) for c, n in zip(_SHAPE, options.shape)})


def gather_summary(points: DataFrame, bricks: DataFrame, options: BlockOptions, shape, edge: int = 64,
                   portable: bool = False) -> DataFrame:
    """``point_id, n, sum_v, max_v``; points carry ``point_id, volume_id, x..nz``."""
    return read_summary(_with_shape(points, options, portable), bricks, Reads.of(options), shape, edge)


def gather_blocks(points: DataFrame, bricks: DataFrame, options: BlockOptions, shape, edge: int = 64,
                  portable: bool = False) -> DataFrame:
    """``point_id, block``: little-endian uint16 cells in (z, y, x) order."""
    return read_blocks(_with_shape(points, options, portable), bricks, Reads.of(options), shape, edge).select("point_id", "block")


def read_summary(points: DataFrame, bricks: DataFrame, reads: Reads, shape, edge: int = 64) -> DataFrame:
    """``point_id, n, sum_v, max_v`` of placed points (columns ``POINT``), each with a block shape of its own.

    Nearest reads are summed brick by brick. Trilinear cells are whole only
    after their shares have met, so those are summed from finished blocks.
    """
    kind = _id_type(points)
    if reads.interpolated:
        return block_sums(read_blocks(points, bricks, reads, shape, edge)).drop(*_SHAPE)
    parts = _met(points, bricks, reads, shape, edge).mapInArrow(_read_cells(reads, shape, edge, True), f"point_id {kind}, n bigint, sum_v bigint, max_v int")
    return parts.groupBy("point_id").agg(F.max("n").alias("n"), F.sum("sum_v").alias("sum_v"), F.max("max_v").alias("max_v"))


def read_blocks(points: DataFrame, bricks: DataFrame, reads: Reads, shape, edge: int = 64) -> DataFrame:
    """``point_id, nz, ny, nx, block`` of placed points (columns ``POINT``): packed blocks with their extents.

    Each part carries a bit per cell it owns and only those values, so every
    cell value travels once. A group holds the parts of one block.
    """
    kind, extents = _id_type(points), ", ".join(f"{c} int" for c in _SHAPE)
    parts = _met(points, bricks, reads, shape, edge).mapInArrow(_read_cells(reads, shape, edge, False), f"point_id {kind}, mask binary, cells binary, {extents}")
    grouped = parts.groupBy("point_id", *_SHAPE).agg(F.collect_list(F.struct("mask", "cells")).alias("parts"))

    def merge(batches):
        for batch in batches:
            blocks, start, held = [], 0, 0
            lists = batch.column("parts")
            ends = lists.offsets.to_numpy()
            masks, values = (lists.values.field(k) for k in range(2))
            counts = np.prod([batch.column(c).to_numpy().astype("i8") for c in _SHAPE], axis=0)
            for row, (low, high) in enumerate(zip(ends[:-1], ends[1:])):
                block = np.zeros(counts[row], reads.part)
                for k in range(low, high):
                    mask = np.unpackbits(np.frombuffer(masks[k].as_buffer(), "u1"), count=len(block)).astype(bool)
                    block[mask] += np.frombuffer(values[k].as_buffer(), reads.part)
                if reads.interpolated:
                    block = np.mod(np.floor(block + 1e-6), 65536).astype("<u2")
                blocks.append(block.tobytes())
                held += block.nbytes
                if held > BYTES_PER_BATCH or row == batch.num_rows - 1:  # blocks differ in size; batches do not
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(start, len(blocks)) for c in ("point_id", *_SHAPE)] + [pa.array(blocks, pa.binary())], ["point_id", *_SHAPE, "block"])
                    blocks, start, held = [], row + 1, 0

    return grouped.mapInArrow(merge, f"point_id {kind}, {extents}, block binary")


def block_sums(blocks: DataFrame) -> DataFrame:
    """``point_id, nz, ny, nx, n, sum_v, max_v`` of packed blocks."""
    def add(batches):
        for batch in batches:
            rows = [np.frombuffer(b.as_buffer(), "<u2") for b in batch.column("block")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([len(r) for r in rows], pa.int64()), pa.array([int(r.sum(dtype="i8")) for r in rows], pa.int64()),
                 pa.array([int(r.max()) for r in rows], pa.int32())], ["point_id", *_SHAPE, "n", "sum_v", "max_v"])

    kind, extents = _id_type(blocks), ", ".join(f"{c} int" for c in _SHAPE)
    return blocks.select("point_id", *_SHAPE, "block").mapInArrow(add, f"point_id {kind}, {extents}, n bigint, sum_v bigint, max_v int")


def _id_type(points: DataFrame) -> str:
    return points.schema["point_id"].dataType.simpleString()


# --- other reads from bricks ----------------------------------------------------------


def _unit_basis() -> dict[str, Column]:
    return {f"b{a}{b}": F.lit(1.0 if a == b else 0.0) for a in "xyz" for b in "xyz"}


def place_requests(requests: DataFrame) -> DataFrame:
    """Requests (request_id, cx, cy, cz, rx, ry, rz and perhaps the nine basis columns) as placed points of 2r + 1 cells an axis."""
    basis = {name: F.col(name) if name in requests.columns else value for name, value in _unit_basis().items()}
    volume = F.col("volume_id") if "volume_id" in requests.columns else F.lit(0)
    return requests.select(F.col("request_id").alias("point_id"), volume.alias("volume_id"), *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "cz")],
                           *[c.alias(n) for n, c in basis.items()], *[(2 * F.col(f"r{a}") + 1).cast("int").alias(f"n{a}") for a in "zyx"])


def request_blocks(requests: DataFrame, bricks: DataFrame, shape, edge: int = 64, interval: float = 1.0) -> DataFrame:
    """``point_id, nz, ny, nx, block``: packed blocks whose radii differ from request to request."""
    return read_blocks(place_requests(requests), bricks, Reads((interval,) * 3, offsets="radius"), shape, edge)


def place_axis_aligned(points: DataFrame, block, shape) -> DataFrame:
    """Points (point_id, volume_id, x..z, nx..nz) as boxes turned to the strongest normal axis, in steps of one voxel.

    The box of :func:`.gather.axis_aligned` in the terms of a placed point: the voxel of cell 0, and for each block
    axis the volume axis it runs along. Boxes that leave the volume, and shapes that the quarter turn does not
    map onto themselves, read nothing.
    """
    sz, sy, sx = block
    rz, ry, rx = sz // 2, sy // 2, sx // 2
    size = dict(zip("zyx", shape))
    ax, ay, az = (F.abs(F.col(c)) for c in ("nx", "ny", "nz"))
    case = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
    strongest = F.when(case == 0, F.col("nx")).when(case == 1, F.col("ny")).otherwise(F.col("nz"))
    start = points.select("point_id", "volume_id", case.alias("case"), (strongest < 0).alias("turned"), *[F.rint(F.col(c)).cast("int").alias(f"m{c}") for c in "xyz"])
    # Per case and volume axis: half size, which block axis runs along it, and in which direction.
    along = {0: {"x": (rz, "z", 1), "y": (rx, "y", 1), "z": (ry, "x", -1)}, 1: {"x": (ry, "x", 1), "y": (rz, "z", 1), "z": (rx, "y", -1)},
             2: {"x": (rx, "x", 1), "y": (ry, "y", 1), "z": (rz, "z", 1)}}
    yields = {0: (2 * rz, 2 * rx, 2 * ry), 1: (2 * rz, 2 * rx, 2 * ry), 2: (2 * rz, 2 * ry, 2 * rx)}
    cells = {"z": sz, "y": sy, "x": sx}
    reads, corner, basis = F.lit(False), {a: F.lit(0) for a in "xyz"}, dict.fromkeys(_BASIS, F.lit(0.0))
    for k, axes in along.items():
        here = F.col("case") == k
        fits = F.lit(yields[k] == (sz, sy, sx))
        for a, (half, name, direction) in axes.items():
            fits = fits & (F.col(f"m{a}") - half >= 0) & (F.col(f"m{a}") + half <= size[a])
            first = F.col(f"m{a}") - half if direction > 0 else F.col(f"m{a}") + half - 1
            back = F.col("turned") & F.lit(name in "zy")  # of a turned box, the first two block axes run backwards
            last = first + direction * (cells[name] - 1)
            corner[a] = F.when(here, F.when(back, last).otherwise(first)).otherwise(corner[a])
            basis[f"b{name}{a}"] = F.when(here, F.when(back, -1.0 * direction).otherwise(1.0 * direction)).otherwise(basis[f"b{name}{a}"])
        reads = reads | (here & fits)
    return start.select("point_id", "volume_id", *[corner[a].cast("double").alias(f"c{a}") for a in "xyz"], *[c.alias(n) for n, c in basis.items()],
                        *[F.lit(n).alias(c) for c, n in zip(_SHAPE, block)], reads.alias("reads"))


AXIS_ALIGNED = Reads(offsets="corner", rounding=0.0)


def place_oblique(requests: DataFrame, key: str, radius: int) -> DataFrame:
    """Requests (key, x, y, z, ax, ay, az) as square planes of 2 * radius + 1 cells, turned by their angles; rows are those of the transposed picture."""
    axes = {n: g.euler_rotate(g.Vec(*[F.lit(1.0 if a == n else 0.0) for a in "xyz"]), F.col("ax"), F.col("ay"), F.col("az")) for n in "xyz"}
    volume = F.col("volume_id") if "volume_id" in requests.columns else F.lit(0)
    side = F.lit(2 * radius + 1)
    return requests.select(F.col(key).alias("point_id"), volume.alias("volume_id"), *[F.col(a).cast("double").alias(f"c{a}") for a in "xyz"],
                           *[c.alias(f"b{n}{a}") for n, vec in axes.items() for a, c in zip("xyz", vec)], F.lit(1).alias("nz"), side.alias("ny"), side.alias("nx"))


def oblique_blocks(requests: DataFrame, bricks: DataFrame, key: str, radius: int, resolution: float, shape, edge: int = 64) -> DataFrame:
    """``point_id, nz, ny, nx, block``: oblique slices as packed planes. Positions outside the volume read the nearest voxel inside, which a border brick owns like any other."""
    return read_blocks(place_oblique(requests, key, radius), bricks, Reads((1.0 / resolution,) * 3, "radius", 0.0, clamp=True), shape, edge)


def unpack_blocks(blocks: DataFrame, chunk: int = 1 << 18) -> DataFrame:
    """``point_id, cell, v``: a row per cell of packed blocks, for consumers that want rows."""
    kind = blocks.schema["point_id"].dataType.simpleString()

    def decode(batches):
        for batch in batches:
            for point, data in zip(batch.column("point_id"), batch.column("block")):
                cells = np.frombuffer(data.as_buffer(), "<u2")
                for at in range(0, len(cells), chunk):
                    part = cells[at:at + chunk]
                    ids = pa.array([point.as_py()], batch.schema.field("point_id").type).take(pa.array(np.zeros(len(part), "i4")))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(at, at + len(part), dtype="i4")), pa.array(part.astype("i4"))], ["point_id", "cell", "v"])

    return blocks.select("point_id", "block").mapInArrow(decode, f"point_id {kind}, cell int, v int")
