"""Reads from stored bricks: what is opened, what is read, and blocks of any shape against loops."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelsheet.operators import bricks, gather
from voxelsheet.sources import volumes

from test_properties import brute_nearest, points_table, random_points, volume_table

SHAPE = (21, 19, 37)


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(8).integers(0, 65536, SHAPE)


@pytest.fixture(scope="module")
def stored(spark, cube, tmp_path_factory):
    """Raw slices packed to bricks of 4 voxels and stored."""
    folder = tmp_path_factory.mktemp("bricks")
    volumes.write_slices(volume_table(spark, cube), str(folder / "raw"), SHAPE, {})
    bricks.write_bricks(volumes.pack_slices(spark, str(folder / "raw"), edge=4, bands_per_task=2), str(folder / "packed"))
    return str(folder / "packed")


def test_slices_pack_like_voxels(spark, cube, stored):
    want = {tuple(r)[:4]: bytes(r.data) for r in bricks.pack_bricks(volume_table(spark, cube), edge=4).collect()}
    got = {tuple(r)[:4]: bytes(r.data) for r in bricks.read_bricks(spark, stored).collect()}
    assert got == want and len(got) == 6 * 5 * 10
    wide = volumes.pack_slices(spark, stored.replace("packed", "raw"), edge=16)
    assert {tuple(r)[:4] for r in wide.collect()} == {(0, z, y, x) for z in range(2) for y in range(2) for x in range(3)}


def test_untouched_bricks_are_not_opened(spark, cube, stored):
    """Files of rows of bricks that no point touches are broken on purpose; the read does not notice."""
    centers = np.array([[5.0, 6.0, 9.0], [30.0, 5.0, 9.0]])
    points = points_table(spark, centers, np.array([[0.0, 0.0, 1.0]] * 2))
    options = gather.BlockOptions(shape=(2, 2, 2))
    want = [int(brute_nearest(cube, c, (0.0, 0.0, 1.0), (2, 2, 2)).sum()) for c in centers]
    import shutil

    copy = stored + "-broken"
    shutil.copytree(stored, copy)
    broken = [f for f in glob.glob(f"{copy}/*/bz=*/by=*/*.parquet") if "/bz=2/by=1/" not in f]
    assert len(broken) > 20
    for file in broken:
        with open(file, "wb") as f:
            f.write(b"no parquet")
    for crc in glob.glob(f"{copy}/*/*/*/.*.crc"):
        os.unlink(crc)
    found = bricks.gather_summary(points, bricks.read_bricks(spark, copy), options, SHAPE, edge=4)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.sum_v for r in found.orderBy("point_id").collect()] == want


def requests_of(spark, seed, n=40):
    rng = np.random.default_rng(seed)
    rows = [(k, *[float(v) for v in rng.uniform(-4, 40, 3)], *[int(v) for v in rng.integers(0, 9, 3)]) for k in range(n)]
    rows[0] = (0, 500.0, 3.0, 3.0, 1, 1, 1)
    return rows, spark.createDataFrame(rows, "request_id int, cx double, cy double, cz double, rx int, ry int, rz int")


def test_requests_of_any_radius(spark, cube, stored, monkeypatch):
    monkeypatch.setattr(bricks, "CELLS_PER_BATCH", 500)
    rows, requests = requests_of(spark, 4)
    got = {r.point_id: r for r in bricks.request_blocks(requests, bricks.read_bricks(spark, stored), SHAPE, edge=4).collect()}
    assert len(got) == len(rows)
    for k, cx, cy, cz, rx, ry, rz in rows:
        want = np.zeros((2 * rz + 1, 2 * ry + 1, 2 * rx + 1), int)
        for index in np.ndindex(want.shape):
            z, y, x = (int(c + i - r + 0.5) for c, i, r in zip((cz, cy, cx), index, (rz, ry, rx)))
            if 0 <= z < SHAPE[0] and 0 <= y < SHAPE[1] and 0 <= x < SHAPE[2]:
                want[index] = cube[z, y, x]
        assert (got[k].nz, got[k].ny, got[k].nx) == want.shape
        assert (np.frombuffer(got[k].block, "<u2").reshape(want.shape) == want).all()
    sums = {r.point_id: r for r in bricks.read_summary(bricks.place_requests(requests), bricks.read_bricks(spark, stored), bricks.Reads(offsets="radius"), SHAPE, edge=4).collect()}
    assert all(sums[k].sum_v == np.frombuffer(got[k].block, "<u2").sum() and sums[k].n * 2 == len(got[k].block) for k in got)


@pytest.mark.parametrize("block", [(4, 4, 4), (2, 4, 4), (4, 2, 6)])
def test_boxes_along_the_axes_are_those_of_the_row_form(spark, cube, stored, block):
    rng = np.random.default_rng(6)
    centers, normals = random_points(rng, 60, SHAPE)
    points = points_table(spark, centers, normals).withColumn("volume_id", F.lit(0))
    hits = gather.axis_aligned(points, volume_table(spark, cube), ["point_id"], block, SHAPE)
    want = {r.point_id: r.block for r in gather.as_blocks(hits, ["point_id"], int(np.prod(block))).collect()}
    placed = bricks.place_axis_aligned(points, block, SHAPE)
    got = bricks.read_blocks(placed, bricks.read_bricks(spark, stored), bricks.AXIS_ALIGNED, SHAPE, edge=4).collect()
    assert {r.point_id: np.frombuffer(r.block, "<u2").tolist() for r in got} == want
    assert any(sum(v) for v in want.values())


def test_oblique_planes_are_those_of_the_row_form(spark, cube, stored):
    rng = np.random.default_rng(7)
    rows = [(k, *[float(v) for v in rng.uniform(-30, 60, 3)], *[float(v) for v in rng.uniform(-3, 3, 3)]) for k in range(25)]
    requests = spark.createDataFrame(rows, "id int, x double, y double, z double, ax double, ay double, az double")
    cells = gather.oblique_slice(requests, volume_table(spark, cube), ["id"], 5, 2.0, SHAPE).collect()
    want = {(r.id, r.row * 11 + r.col): r.v for r in cells}
    planes = bricks.oblique_blocks(requests, bricks.read_bricks(spark, stored), "id", 5, 2.0, SHAPE, edge=4)
    got = {(r.point_id, r.cell): r.v for r in bricks.unpack_blocks(planes, chunk=50).collect()}
    assert got == want and len(got) == 25 * 121


def test_clamped_cells_are_spread_over_chunks(spark, cube, stored, monkeypatch):
    """Planes far outside read border voxels only; they come in bounded chunks, not as rows with one key."""
    monkeypatch.setattr(bricks, "CHUNK_POINTS", 5)
    rows = [(k, -900.0, -900.0, -900.0, 0.0, 0.0, 0.0) for k in range(60)]
    requests = spark.createDataFrame(rows, "id int, x double, y double, z double, ax double, ay double, az double")
    met = bricks._met(bricks.place_oblique(requests, "id", 3), bricks.read_bricks(spark, stored), bricks.Reads((0.5,) * 3, "radius", 0.0, clamp=True), SHAPE, 4)
    sizes = [len(r.points) for r in met.collect()]
    assert sum(sizes) == 60 and len(sizes) > 6 and max(sizes) < 20
    planes = bricks.oblique_blocks(requests, bricks.read_bricks(spark, stored), "id", 3, 2.0, SHAPE, edge=4).collect()
    assert len(planes) == 60 and all(set(np.frombuffer(r.block, "<u2")) == {cube[0, 0, 0]} for r in planes)


def test_nothing_stored_and_nothing_asked(spark, stored):
    rows, requests = requests_of(spark, 4)
    none = bricks.read_bricks(spark, stored).filter("false")
    assert {sum(r.block) for r in bricks.request_blocks(requests, none, SHAPE, edge=4).collect()} == {0}
    assert bricks.request_blocks(requests.filter("false"), bricks.read_bricks(spark, stored), SHAPE, edge=4).count() == 0
