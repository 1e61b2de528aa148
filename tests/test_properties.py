"""Checks against brute force and against invariants, on small random data."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelsheet.functions import ordering, tensors
from voxelsheet.operators import blocks, bricks, catalog, datasets, gather, manifests, models, patches, regions, stacks, stamps, stencils
from voxelsheet.sources import surface_maps, tables, volumes


def volume_table(spark, cube):
    z, y, x = (a.ravel() for a in np.indices(cube.shape))
    rows = list(zip([0] * cube.size, z.tolist(), y.tolist(), x.tolist(), cube.ravel().tolist()))
    return spark.createDataFrame(rows, "volume_id int, z int, y int, x int, v int")


def random_points(rng, n, shape):
    normals = rng.normal(size=(n, 3))
    centers = rng.uniform(-4, np.array(shape[::-1]) + 4, (n, 3))
    return centers, normals


def points_table(spark, centers, normals):
    rows = [(i, 0, *map(float, c), *map(float, n)) for i, (c, n) in enumerate(zip(centers, normals))]
    return spark.createDataFrame(rows, "point_id long, volume_id int, x double, y double, z double, nx double, ny double, nz double")


def brute_nearest(cube, center, normal, shape):
    n = normal / np.linalg.norm(normal)
    a, b, c = n
    k = 1 / (1 + c) if c >= 0 else (1 - c) / (a * a + b * b)
    axes = np.array([[1 - a * a * k, -a * b * k, -a], [-a * b * k, 1 - b * b * k, -b], [a, b, c]])
    out = np.zeros(shape, int)
    for cell in np.ndindex(*shape):
        off = [int(-(m - 1) / 2 + i + 0.5) for m, i in zip(shape, cell)]
        p = center + off[2] * axes[0] + off[1] * axes[1] + off[0] * axes[2]
        x, y, z = (int(v + 0.5) for v in p)
        if 0 <= z < cube.shape[0] and 0 <= y < cube.shape[1] and 0 <= x < cube.shape[2]:
            out[cell] = cube[z, y, x]
    return out


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(3)
    cube = rng.integers(0, 65536, (11, 13, 17))
    centers, normals = random_points(rng, 40, cube.shape)
    centers[0] = (100.0, 100.0, 100.0)  # outside everywhere
    return cube, centers, normals, volume_table(spark, cube), points_table(spark, centers, normals)


def test_gathers_equal_brute_force(spark, scene, monkeypatch):
    """Row form, brick form and a loop agree cell by cell, also with many chunks per brick."""
    monkeypatch.setattr(bricks, "CHUNK_POINTS", 3)
    cube, centers, normals, voxels, points = scene
    options = gather.BlockOptions(shape=(4, 3, 5))
    want = [brute_nearest(cube, c, n, (4, 3, 5)).ravel().tolist() for c, n in zip(centers, normals)]
    hits = gather.gather(points, voxels, ["point_id"], options, cube.shape)
    rows = gather.as_blocks(hits, ["point_id"], options.cells).orderBy("point_id").collect()
    assert [r.block for r in rows] == want
    packed = bricks.pack_bricks(voxels, edge=4)
    dense = bricks.gather_blocks(points, packed, options, cube.shape, edge=4).orderBy("point_id").collect()
    assert [np.frombuffer(r.block, "<u2").tolist() for r in dense] == want
    sums = bricks.gather_summary(points, packed, options, cube.shape, edge=4).orderBy("point_id").collect()
    assert [(r.n, r.sum_v, r.max_v) for r in sums] == [(60, sum(w), max(w)) for w in want]


def test_trilinear_at_whole_positions_is_nearest(spark, scene):
    cube, _, _, voxels, _ = scene
    points = points_table(spark, [(5.0, 6.0, 4.0), (0.0, 0.0, 0.0)], [(0.0, 0.0, 1.0)] * 2)
    blocks_of = lambda m: [r.block for r in gather.as_blocks(gather.gather(
        points, voxels, ["point_id"], gather.BlockOptions(shape=(2, 2, 2), method=m), cube.shape), ["point_id"], 8).orderBy("point_id").collect()]
    assert blocks_of("interpolated") == blocks_of("nearest_neighbor")


@pytest.mark.parametrize("compat", [False, True])
def test_trilinear_bricks_equal_the_row_form(spark, scene, compat):
    cube, _, _, voxels, points = scene
    options = gather.BlockOptions(shape=(3, 4, 2), method="interpolated", compat_corner=compat)
    hits = gather.gather(points, voxels, ["point_id"], options, cube.shape)
    want = [r.block for r in gather.as_blocks(hits, ["point_id"], options.cells).orderBy("point_id").collect()]
    packed = bricks.pack_bricks(voxels, edge=4)
    got = bricks.gather_blocks(points, packed, options, cube.shape, edge=4).orderBy("point_id").collect()
    assert [np.frombuffer(r.block, "<u2").tolist() for r in got] == want
    sums = bricks.gather_summary(points, packed, options, cube.shape, edge=4).orderBy("point_id").collect()
    assert [(r.sum_v, r.max_v) for r in sums] == [(sum(w), max(w)) for w in want]


def test_a_trilinear_cell_meets_one_tile(spark):
    """Every cell's eight corners are in the tile of its first one; voxels listed twice count twice, as do points."""
    rng = np.random.default_rng(8)
    cube = rng.integers(1, 65536, (6, 9, 5))
    voxels = volume_table(spark, cube).unionByName(spark.createDataFrame([(0, 4, 8, 4, 5), (0, 0, 0, 0, None), (0, 9, 9, 9, 7)], "volume_id int, z int, y int, x int, v int"))
    tiles = {(r.tz, r.ty, r.tx): r.tile for r in gather.corner_tiles(voxels, cube.shape).collect()}
    cube[4, 8, 4] += 5
    for z, y, x in np.ndindex(7, 10, 6):
        z, y, x = z - 1, y - 1, x - 1
        tile = tiles.get((z >> 2, y >> 2, x >> 2), {})
        for dz, dy, dx in np.ndindex(2, 2, 2):
            at = z + dz, y + dy, x + dx
            inside = all(0 <= a < n for a, n in zip(at, cube.shape))
            assert tile.get((((z & 3) + dz) * 5 + (y & 3) + dy) * 5 + (x & 3) + dx) == (cube[at] if inside else None)
    options = gather.BlockOptions(shape=(2, 2, 2), method="interpolated")
    point = points_table(spark, [(2.25, 3.5, 1.75)], [(0.3, 0.2, 1.0)])
    once, twice = ({r.cell: r.v for r in gather.gather(p, voxels, ["point_id"], options, cube.shape).collect()} for p in (point, point.union(point)))
    assert once.keys() == twice.keys() == set(range(-1, 8)) and once[-1] is None
    assert all((twice[c] - 2 * once[c]) % 65536 in (0, 1) for c in range(8))


def test_unknown_method(spark, scene):
    with pytest.raises(ValueError):
        gather.gather(scene[4], scene[3], ["point_id"], gather.BlockOptions(method="cubic"), scene[0].shape)


def test_stamp_then_gather_is_identity(spark):
    tiles = spark.createDataFrame([(x, y, x * 31 + y) for x in range(2, 16, 4) for y in range(2, 12, 4)], "px int, py int, v int")
    image = stamps.prediction_image(tiles.withColumn("seq", F.lit(1)), 4, 16, 12, [], "v", ["seq"])
    assert image.count() == 16 * 12
    again = image.withColumn("face_id", F.lit(0))
    hits = gather.label_hits(tiles.withColumn("face_id", F.lit(0)), again, ["px", "py"], F.col("v"), (4, 4))
    for row in gather.as_blocks(hits, ["px", "py"], 16).collect():
        assert row.block == [row.px * 31 + row.py] * 16


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_over_buckets(spark, inclusive):
    rng = np.random.default_rng(1)
    steps = rng.permutation(500)
    values = rng.integers(-50, 50, 500)
    df = spark.createDataFrame([(int(s), int(v), int(s) % 2) for s, v in zip(steps, values)], "s int, v int, g int")
    parts = {"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    got = ordering.running(df, F.floor(F.col("s") / 37), ["s"], parts, ["g"], inclusive).orderBy("s").toPandas()
    by_step = dict(zip(steps.tolist(), values.tolist()))
    for row in got.itertuples():
        seen = [by_step[k] for k in range(row.s % 2, row.s + (1 if inclusive else 0), 2)]
        assert row.total == sum(seen)
        if seen:
            assert (row.low, row.high) == (min(seen), max(seen))


def test_row_numbers(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10**9)))
    got = ordering.number_rows(df, F.floor(F.col("k") / 10**7), ["k", "id"]).orderBy("k", "id").collect()
    assert [r.rn for r in got] == list(range(1, 1001))


def test_long_counts_are_split(spark):
    df = spark.createDataFrame([(1, 200_000), (2, 0), (3, 5)], "a int, n int")
    out = ordering.explode_count(df, F.col("n"), "i", chunk=1000)
    rows = {r.a: (r.c, r.lo, r.hi) for r in out.groupBy("a").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert rows == {1: (200_000, 0, 199_999), 3: (5, 0, 4)}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {0: rng.integers(-2000, 100_000, 3001), 1: np.full(50, 7), 2: np.array([9])}
    df = spark.createDataFrame([(k, int(v)) for k, vs in data.items() for v in vs], "k int, v int")
    shares = {"a": 0, "b": 1, "c": 50, "d": 97, "e": 100}
    for row in stacks.exact_percentiles(df, ["k"], "v", shares, 512).collect():
        for n, share in shares.items():
            assert row[n] == pytest.approx(np.percentile(data[row.k], share) * 100)


def reflect(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


@pytest.mark.parametrize("height, width", [(9, 30), (3, 5)])
def test_blur_equals_brute_force(spark, height, width):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 5000, (height, width))
    df = spark.createDataFrame([(0, y, x, int(image[y, x])) for y in range(height) for x in range(width)], "z int, py int, px int, v int")
    got = stencils.gaussian_blur(df, ["z"], "v", width, height, 3.0, whole=False).collect()
    w = stencils.gaussian_weights(3.0)
    down = np.array([[sum(w[k + 12] * image[reflect(y + k, height), x] for k in range(-12, 13)) for x in range(width)] for y in range(height)])
    for row in got:
        assert row.v == pytest.approx(sum(w[k + 12] * down[row.py, reflect(row.px + k, width)] for k in range(-12, 13)))


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_tiles_do_not_show(spark, tile):
    """Blur, median and statistics are the same whatever the tile size, with absent pixels as 0."""
    rng = np.random.default_rng(8)
    height, width = 11, 17
    cells = [(z, int(y), int(x), int(rng.integers(1, 9000))) for z in range(3) for y in range(height) for x in range(width) if rng.random() < 0.1 * z + 0.02]
    df = spark.createDataFrame(cells, "z int, py int, px int, v int")
    full = {z: np.zeros((height, width), int) for z in sorted({c[0] for c in cells})}
    for z, y, x, v in cells:
        full[z][y, x] = v
    w = stencils.gaussian_weights(3.0)
    blurred = {z: stencils.blur_patch(np.pad(a, 12, mode="symmetric"), w) for z, a in full.items()}
    medians = {z: np.median(np.stack([np.pad(a, 1, mode="symmetric")[i:i + height, j:j + width] for i in range(3) for j in range(3)]), axis=0) for z, a in full.items()}
    for made, want in ((stencils.gaussian_blur(df, ["z"], "v", width, height, tile=tile), blurred), (stencils.dense(df, ["z"], "v", width, height, tile=tile), full),
                       (stencils.median3(df, ["z"], "v", width, height, tile=tile), medians)):
        rows = made.collect()
        assert len(rows) == len(full) * height * width and all(r.v == want[r.z][r.py, r.px] for r in rows)
    for r in stencils.raw_and_blurred(df, ["z"], "v", width, height, tile=tile).collect():
        for a, got in ((full[r.z], (r.min, r.max, r.mean)), (blurred[r.z], (r.blurred_min, r.blurred_max, r.blurred_mean))):
            assert got == (a.min(), a.max(), pytest.approx(a.mean()))


def test_permutations_of_large_blocks(spark):
    """Building and running all turns of the default sample shape takes seconds, and agrees with numpy."""
    shape = (48, 48, 48)
    block = np.random.default_rng(3).integers(0, 65536, shape)
    df = spark.createDataFrame([(block.ravel().tolist(),)], "b array<int>")
    started = time.time()
    columns = [tensors.turn_and_mirror(F.col("b"), shape, k, m).alias(f"t{k}{int(m)}") for k in range(4) for m in (False, True)]
    row = df.select(*columns, tensors.mirror_x(F.col("b"), shape).alias("x"), tensors.mirror_y(F.col("b"), shape).alias("y"),
                    *[c.alias(f"c{i}") for i, c in enumerate(tensors.central_slices(F.col("b"), shape))]).first()
    assert time.time() - started < 30
    for k in range(4):
        turned = np.rot90(block, k, axes=(1, 2))
        assert row[f"t{k}0"] == turned.ravel().tolist() and row[f"t{k}1"] == turned[:, :, ::-1].ravel().tolist()
    assert row.x == block[:, :, ::-1].ravel().tolist() and row.y == block[:, ::-1].ravel().tolist()
    assert row.c0 == block[24].ravel().tolist() and row.c1 == block[:, 24].ravel().tolist() and row.c2 == block[:, :, 24].ravel().tolist()


def test_dense_blocks_keep_empty_keys(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 0, 7), (2, None, None)], "k int, cell int, v int")
    rows = blocks.dense_blocks(df, ["k"], "cell", "v", 3, F.col("cell").isNotNull()).orderBy("k").collect()
    assert [r.block for r in rows] == [[7, 0, 5], [0, 0, 0]]


def test_asof_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    seen = [(0, int(k)) for k in rng.choice(10_000, 300, replace=False)] + [(1, 50)]
    asked = [(int(rng.integers(0, 2)), int(k), i) for i, k in enumerate(rng.integers(0, 10_000, 500))]
    observed = spark.createDataFrame(seen, "g int, k long").withColumn("p", F.col("k") * 2)
    got = catalog.asof_join(spark.createDataFrame(asked, "g int, k long, id int"), observed, ["g"], "k", ["p"], 97).collect()
    assert len(got) == 500
    for row in got:
        below = [k for g, k in seen if g == row.g and k <= row.k]
        assert row.matched_key == (max(below) if below else None)
        assert row.p == (2 * max(below) if below else None)


def test_locate_covers_every_index(spark):
    lengths = spark.createDataFrame([("a", 0, 3), ("b", 1, 0), ("c", 2, 200_000), ("d", 3, 1)], "path string, source_ord int, n long")
    asked = spark.createDataFrame([(i,) for i in (0, 2, 3, 70_000, 200_002, 200_003, 200_004)], "i long")
    rows = datasets.locate(asked, lengths, "i").orderBy("i").collect()
    assert [(r.path, r.local_index) for r in rows] == [("a", 0), ("a", 2), ("c", 0), ("c", 69_997), ("c", 199_999), ("d", 0), (None, None)]


def test_names_in_paths(spark):
    names = spark.createDataFrame([("n1",), ("n12",), ("zz",)], "name string")
    paths = spark.createDataFrame([("x/n12.json",), ("n1",), ("q",)], "path string")
    got = {tuple(r) for r in catalog.names_in_paths(names, paths, "name", "path").select("path", "name").collect()}
    assert got == {("x/n12.json", "n1"), ("x/n12.json", "n12"), ("n1", "n1")}


def test_merge_takes_the_first_image_whole(spark):
    rows = [(0, r, x, 0, 10 * r + x, b[0], 0, b[1], 1) for r, b in enumerate([(0, 1), (2, 4), (3, 5)]) for x in range(6)]
    df = spark.createDataFrame(rows, "face_id int, rank int, px int, py int, v int, x0 int, y0 int, x1 int, y1 int")
    got = [r.v for r in regions.merge_on_face(df, "rank", "v").orderBy("px").collect()]
    assert got == [0, 1, 12, 23, 24, 5]


def test_patches_cover_the_image(spark):
    image = np.arange(7 * 10).reshape(7, 10)
    df = spark.createDataFrame([(y, x, int(image[y, x])) for y in range(7) for x in range(10)], "py int, px int, v int")
    arrays = patches.patch_arrays(patches.patch_cells(df, 4, 3), [], "v", 4).collect()
    assert len(arrays) == 3 * 4
    for row in arrays:
        want = np.zeros((4, 4), int)
        part = image[row.patch_y:row.patch_y + 4, row.patch_x:row.patch_x + 4]
        want[:part.shape[0], :part.shape[1]] = part
        assert row.block == want.ravel().tolist()


def test_manifest_loop_is_reported_once(spark):
    edges = spark.createDataFrame([("a.txt", "b.txt", 0), ("b.txt", "a.txt", 0), ("b.txt", "x.json", 1)], "parent string, child string, ord long")
    roots = spark.createDataFrame([("a.txt", 0)], "path string, ord int")
    rows = manifests.repeated_lists(edges, roots).collect()
    assert [(r.parent, r.child, r.loop) for r in rows] == [("b.txt", "a.txt", True)]
    assert [r.path for r in manifests.flatten(edges, roots).collect()] == ["x.json"]


def test_audit_of_references(spark):
    columns = ", ".join(f"{k} string" for k in ("path", *manifests.PATH_KEYS))
    d = spark.createDataFrame([("a", "v", "p", None, None, None, "t")], columns)
    there = spark.createDataFrame([("v",), ("t",)], "path string")
    assert [(r.key, r.target) for r in manifests.audit_references(d, there).collect()] == [("ppm", "p")]


# --- files ---------------------------------------------------------------------------


def test_surface_map_layout(spark, tmp_path):
    path = str(tmp_path / "m.ppm")
    data = np.random.default_rng(6).normal(size=(5, 7, 6))
    rows = [(0, x, y, *map(float, data[y, x])) for y in range(5) for x in range(7)]
    surface_maps.write_surface_map(spark.createDataFrame(rows, surface_maps.SCHEMA), path, 7, 5)
    raw = open(path, "rb").read()
    head = b"width: 7\nheight: 5\ndim: 6\nordered: true\ntype: double\nversion: 1.0\n<>\n"
    assert raw == head + data.astype("<f8").tobytes()
    back = surface_maps.read_surface_map(spark, path, rows_per_task=2).orderBy("py", "px").collect()
    assert np.array_equal(np.array([r[3:] for r in back]).reshape(5, 7, 6), data)


def test_surface_map_with_comments_and_wrong_size(spark, tmp_path):
    path = str(tmp_path / "c.ppm")
    head = b"# made by hand\nwidth: 1\nheight: 2\ndim: 6\nordered: false\ntype: double\nversion: 1\n<>\n"
    open(path, "wb").write(head + np.arange(12, dtype="<f8").tobytes())
    assert surface_maps.read_header(path)["ordered"] is False
    assert surface_maps.read_surface_map(spark, path).count() == 2
    open(path, "wb").write(head + np.arange(6, dtype="<f8").tobytes())
    with pytest.raises(Exception, match="records end"):
        surface_maps.read_surface_map(spark, path).count()


def test_raw_slices(spark, tmp_path):
    cube = np.random.default_rng(7).integers(0, 65536, (3, 4, 5)).astype("<u2")
    for z in range(3):
        cube[z].tofile(tmp_path / f"{z:04}.u16")
    (tmp_path / ".hidden.u16").write_bytes(b"x")
    meta = {"voxelsize": 10.0, "slices": 3, "height": 4, "width": 5}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    rows = volumes.read_slices(spark, str(tmp_path), rows_per_task=3).orderBy("z", "y", "x").collect()
    assert [r.v for r in rows] == cube.ravel().tolist()
    part = volumes.read_slices(spark, str(tmp_path), bounding_box="1,1,1,4,3,3").orderBy("z", "y", "x").collect()
    assert [r.v for r in part] == cube[1:3, 1:3, 1:4].ravel().tolist()
    assert (part[0].z, part[0].y, part[0].x) == (0, 0, 0)
    (tmp_path / "meta.json").write_text(json.dumps({**meta, "slices": 9}))
    with pytest.raises(Exception, match="declared"):
        volumes.read_slices(spark, str(tmp_path)).count()


def test_missing_metadata(spark, tmp_path):
    with pytest.raises(Exception):
        volumes.read_slices(spark, str(tmp_path)).count()


def test_metric_series(spark):
    lines = [("f", 0, "2024-01-05,x"), ("f", 1, "a,b,c,d,e,4,1,3"), ("f", 2, "2024-02-01"), ("f", 3, "a,b,c,d,e,9")]
    rows = tables.read_metric_series(spark.createDataFrame(lines, "file string, n int, text string")).orderBy("pair").collect()
    assert [(str(r.date), r["values"]) for r in rows] == [("2024-01-05", [4.0, 1.0, 3.0]), ("2024-02-01", [9.0])]


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = tables.read_bytes(spark, os.path.join(str(tmp_path), "a.bin")).first()
    assert bytes(row.content) == b"abc" and row.folder.endswith(tmp_path.name)


# --- models ---------------------------------------------------------------------------


def samples(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(i % 2, 0.3, 4)], i % 2) for i in range(80)]
    return spark.createDataFrame(rows, "id long, block array<double>, ink int")


def test_warm_start_and_reload(spark, tmp_path):
    df = samples(spark)
    first = models.fit("ink_perceptron", df, "block", layers=[4, 3, 2], maxIter=20, seed=1)
    models.save(first, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert np.allclose(again.stages[0].weights.toArray(), first.stages[0].weights.toArray())
    warm = models.warm_start([4, 3, 2], again, maxIter=1).getStages()[0]
    assert warm.isSet("initialWeights")
    assert np.allclose(warm.getInitialWeights().toArray(), first.stages[0].weights.toArray())
    # only the second layer fits: 3 inputs, 2 outputs, and its biases
    part = models.warm_start([4, 5, 3, 2], again, maxIter=1).getStages()[0].getInitialWeights().toArray()
    assert len(part) == 25 + 18 + 8 and not np.allclose(part[-8:], first.stages[0].weights.toArray()[-8:])
    part = models.warm_start([4, 3, 5], again, maxIter=1).getStages()[0].getInitialWeights().toArray()
    assert np.allclose(part[:15], first.stages[0].weights.toArray()[:15]) and len(part) == 15 + 20
    with pytest.raises(ValueError):
        models.build("unet")


def test_full_rank_reconstruction_is_exact(spark):
    df = samples(spark)
    out = models.reconstruct(models.fit("autoencoder", df, "block", k=4), df, "block", ["id"])
    assert out.agg(F.max("mse")).first()[0] < 1e-20


def test_intensity_matching(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 9.0],)], "b array<double>")
    out = df.select(models.match_intensity(F.col("b"), [0.0, 2.0, 4.0], [10.0, 20.0, 40.0])).first()[0]
    assert out == [10.0, 15.0, 20.0, 30.0, 40.0]


def test_lists_that_share_lists_do_not_multiply(spark):
    """A diamond of 12 levels, each naming the next list twice."""
    edges = [(f"l{k}.txt", f"l{k + 1}.txt", o) for k in range(12) for o in (0, 1)] + [("l12.txt", f"d{k}.json", k) for k in range(3)]
    frame = spark.createDataFrame(edges, "parent string, child string, ord bigint")
    roots = spark.createDataFrame([("l0.txt", 0)], "path string, ord bigint")
    assert manifests.expand(frame, roots, once=True).count() < 40
    rows = manifests.flatten(frame, roots).orderBy("position").collect()
    assert [(r.path, r.position) for r in rows] == [("d0.json", 0), ("d1.json", 1), ("d2.json", 2)]


def test_metric_series_covers_all_events(spark):
    from voxelsheet.registry import load_all

    folder = "/root/testdata/sf0.001"
    rows = load_all()["metric_series_all"].run(spark, folder)
    assert rows.count() == spark.read.parquet(f"{folder}/events.parquet").count()
    assert rows.groupBy("file").count().agg(F.max("count")).first()[0] <= 10_000


def test_default_shape_gather_covers_the_surface(spark):
    """Every surface point has its summary; some of them, off the coarse grid, against the row form."""
    from voxelsheet.plans import samples
    from voxelsheet.registry import load_all
    from voxelsheet.tables import Tables

    folder = "/root/testdata/sf0.001"
    load_all()
    t = Tables(spark, folder)
    out = load_all()["gather_default_shape_all"].run(spark, folder).cache()
    ids = samples.with_point_id(t.surface).select("point_id")
    assert out.count() == ids.count() and not ids.exceptAll(out.select("point_id")).count()
    few = samples.with_point_id(t.surface).filter("px % 25 != 0").orderBy("point_id").limit(3)
    options = gather.BlockOptions(shape=(48, 48, 48))
    want = gather.summarize(gather.gather(few, t.voxels, ["point_id"], options, t.volume_shape), ["point_id"], options.cells)
    want = {r.point_id: (r.n, r.sum_v, r.max_v) for r in want.collect()}
    got = {r.point_id: (r.n, r.sum_v, r.max_v) for r in out.collect() if r.point_id in want}
    assert len(want) == 3 and got == want


def test_truncated_reconstruction(spark):
    """Rank 3 data of more cells than fit a square matrix come back; noise is cut as by a full decomposition."""
    rng = np.random.default_rng(12)
    for cells, noise in ((20_000, 0.0), (60, 0.1)):
        x = 5 + rng.normal(size=(40, 3)) @ rng.normal(size=(3, cells)) + noise * rng.normal(size=(40, cells))
        df = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "id long, block array<double>").repartition(3)
        mean, basis = models.randomized_basis(df, "block", 3)
        out = models.reconstruct_truncated(mean, basis, df, "block", ["id"]).orderBy("id").collect()
        left, size, right = np.linalg.svd(x - x.mean(0), full_matrices=False)
        want = (((left[:, :3] * size[:3]) @ right[:3] + x.mean(0) - x) ** 2).mean(1)
        assert basis.shape == (cells, 3) and np.allclose([r.mse for r in out], want, atol=1e-6)


def test_audit_groups_names_only(spark):
    """Files named twice, names listed twice, unknown or null; what is grouped is a row a name, not one a file."""
    listing = [("a", f"extras/{s}", None) for s in manifests.EXTRAS] + [("a", "_mask.png", "L"), ("a", "_mask.png", "P"), ("a", "other", "X"), ("a", None, None)]
    listing += [("a", "slice", None)] * manifests.SLICES + [("b", "slice", None)] * 2 + [(None, "meta.json", None)]
    names = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    out = manifests.audit(names, spark.createDataFrame(listing, "name string, suffix string, mode string"))
    every = [f"extras/{s}" for s in manifests.EXTRAS] + [*manifests.ROOT_FILES, "meta.json"]
    want = [("a", "_inklabels.png", "missing"), ("a", "meta.json", "missing"), ("a", "_mask.png", "mode")]
    for name in ("b", "b", None):
        want += [(name, s, "missing") for s in every] + [(name, "slice", "slices")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    grouped = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert grouped and all(line.split("Aggregate [")[1].split("]")[0].startswith("name#") and "suffix" not in line.split("Aggregate [")[1].split("]")[0] for line in grouped)


def test_chunks_of_one_brick_are_dealt_apart(spark, scene, monkeypatch):
    """The chunks of a brick that many points touch meet their own copy of it, in tasks of their own."""
    monkeypatch.setattr(bricks, "CHUNK_POINTS", 3)
    cube, _, _, voxels, points = scene
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        options = gather.BlockOptions(shape=(4, 3, 5))
        met = bricks._met(bricks._with_shape(points, options, False), bricks.pack_bricks(voxels, edge=32), bricks.Reads(), cube.shape, 32)
        rows = met.filter("bz = 0 and by = 0 and bx = 0").select(F.spark_partition_id().alias("task"), F.size("points").alias("n"), F.col("data").isNotNull().alias("held")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) > 5 and len({r.task for r in rows}) > 3 and all(r.held for r in rows)


@pytest.mark.parametrize("kind", [(48, 48, 48), (5, 3, 7), (2, 1, 1)])
@pytest.mark.parametrize("clamp", [False, True])
def test_only_cells_near_the_brick_get_a_position(kind, clamp):
    """All owned cells are found by entry and exit of their lines, and few others are looked at."""
    rng = np.random.default_rng(4)
    shape, edge, corner = (7, 90, 70), 32, {"z": 0, "y": 32, "x": 64}
    reads = bricks.Reads(clamp=clamp)
    cube = rng.integers(1, 65536, edge**3).astype("<u2")
    n = 12
    turn = np.array([np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(n - 2)] + [np.eye(3), np.eye(3)[[2, 0, 1]]])
    points = {f"b{a}{b}": turn[:, i, j].copy() for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
    points |= {"cx": rng.uniform(50, 75, n), "cy": rng.uniform(25, 70, n), "cz": rng.uniform(-2, 9, n)}
    one = bricks._Cube(cube, corner, reads, shape, edge, points, kind)
    cell, values = one.nearest()
    steps = np.stack(np.meshgrid(*[reads.along(k) for k in kind], indexing="ij"), -1).reshape(-1, 3)
    at, owned = [], True
    for a, size in zip("zyx", shape):
        p = points[f"c{a}"][:, None] + steps[:, 2] * points[f"bx{a}"][:, None] + steps[:, 1] * points[f"by{a}"][:, None] + steps[:, 0] * points[f"bz{a}"][:, None]
        k = np.trunc(p + 0.5).astype(int)
        k = (np.clip(k, 0, size - 1) if clamp else k) - corner[a]
        owned = owned & (k >= 0) & (k < min(edge, size - corner[a]))
        at.append(k)
    want = np.flatnonzero(owned)
    assert cell.tolist() == want.tolist()
    assert values.tolist() == cube[((at[0] * edge + at[1]) * edge + at[2]).ravel()[want]].tolist()
    if kind[0] == 48 and not clamp:
        assert len(want) and len(one.along) < 3 * len(want) < n * 48**3 / 4
