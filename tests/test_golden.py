"""Hand cases: fixed inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from voxelsheet import session
from voxelsheet.functions import geometry as g, scalars, tensors
from voxelsheet.operators import catalog, gather, manifests, regions, scoring, selection, stacks


def basis(spark, normal):
    df = spark.createDataFrame([normal], "nx double, ny double, nz double")
    unit = df.select(*[c.alias(f"n{a}") for a, c in zip("xyz", g.sampling_normal(g.vec("nx", "ny", "nz")))])
    b = g.basis_from_unit_normal(g.vec("nx", "ny", "nz"))
    return np.array(unit.select(*[c.alias(f"c{i}") for i, c in enumerate(c for v in b for c in v)]).first()).reshape(3, 3)


@pytest.mark.parametrize("normal, expected", [
    ((0.0, 0.0, 1.0), np.eye(3)),
    ((0.0, 0.0, 0.0), np.eye(3)),
    ((0.0, 0.0, -1.0), [[0, 1, 0], [1, 0, 0], [0, 0, -1]]),
    ((10.0, 9.0, 8.0), [[0.72989017, -0.24309886, -0.63887662], [-0.24309886, 0.78121102, -0.57498896], [0.63887662, 0.57498896, 0.51110119]]),
])
def test_basis(spark, normal, expected):
    assert np.allclose(basis(spark, normal), expected, atol=1e-6)


@pytest.mark.parametrize("normal", [(1e-7, 0.0, -1.0), (3e-9, -2e-9, -1.0), (0.3, -0.4, -0.86), (1.0, 0.0, 0.0)])
def test_basis_is_orthonormal_near_the_opposed_case(spark, normal):
    b = basis(spark, normal)
    assert np.allclose(b @ b.T, np.eye(3), atol=1e-9)


def test_quaternion_gives_the_same_axes(spark):
    df = spark.createDataFrame([(10.0, 9.0, 8.0), (0.0, 0.0, -1.0), (0.0, 0.0, 2.0)], "nx double, ny double, nz double")
    up = g.Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    turned = g.with_quaternion_between(df, up, g.vec("nx", "ny", "nz"), "q")
    axes = g.quaternion_matrix([F.col(f"q{a}") for a in "wxyz"])
    rows = turned.select(*df.columns, *[c.alias(f"c{i}") for i, c in enumerate(c for v in axes for c in v)]).collect()
    for row in rows:
        assert np.allclose(np.array(row[3:]).reshape(3, 3), basis(spark, tuple(row[:3])), atol=1e-9)


@pytest.mark.parametrize("n, expected", [(4, [-1, 0, 1, 2]), (3, [0, 0, 1]), (1, [0]), (2, [0, 1])])
def test_offsets(spark, n, expected):
    rows = spark.range(n).orderBy("id").select(g.centered_offset(F.col("id"), n)).collect()
    assert [r[0] for r in rows] == expected


def test_truncation_reads_voxel_zero_from_the_negative_side(spark):
    df = spark.createDataFrame([(-1.4,), (-0.6,), (0.4,), (0.5,)], "p double")
    assert [r[0] for r in df.select(g.truncate(F.col("p") + 0.5)).collect()] == [0, 0, 0, 1]


def test_slab_merge_ranges(spark):
    slices = spark.range(6 * 2150).select((F.col("id") % 6).cast("int").alias("slab"), scalars.int_div(F.col("id"), 6).alias("z"))
    merged = stacks.merge_slabs(slices, [1547, 1549, 1548, 1549, 1549], 2150, reverse=True)
    rows = merged.groupBy("slab").agg(F.count("*").alias("n"), F.min("z_merged").alias("first")).orderBy("first").collect()
    assert [(r.slab, r.n) for r in rows] == [(5, 1549), (4, 1549), (3, 1548), (2, 1549), (1, 1547), (0, 2150)]
    assert sum(r.n for r in rows) == 9892
    assert rows[-1].first + rows[-1].n == 9892


def test_grid_split(spark):
    box = spark.createDataFrame([(0, 0, 640, 400)], "x0 int, y0 int, x1 int, y1 int")
    rows = regions.split_grid(box, 1, 2).orderBy("col").select("x0", "y0", "x1", "y1").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 320, 400), (320, 0, 640, 400)]


def points(spark, positives, negatives):
    return spark.range(positives + negatives).select(
        F.col("id").alias("point_id"), F.when(F.col("id") < positives, 255).otherwise(0).alias("ink"))


def test_oversample_counts(spark):
    out = selection.oversample(points(spark, 10, 95), 0.5)
    assert out.count() == 185 and out.filter("ink = 255").count() == 90


def test_oversample_long_repeats(spark):
    out = selection.oversample(points(spark, 1, 20), 0.9999)
    assert out.filter("ink = 255").count() == int(20 * 0.9999 / (1.0 - 0.9999))


def test_undersample_counts(spark):
    out = selection.undersample(points(spark, 10, 95), 0.25, "point_id", seed=5)
    assert out.filter("ink = 255").count() == 10 and out.filter("ink = 0").count() == 30


def test_iteration_order(spark):
    df = spark.createDataFrame([("final",), ("0_20000",), ("1_0",), ("0_0",)], "i string")
    assert [r.i for r in df.orderBy(scalars.iteration_key(F.col("i"))).collect()] == ["0_0", "0_20000", "1_0", "final"]


def test_empty_denominators(spark):
    rows = spark.createDataFrame([(0, 1, 10), (0, 0, 20)], "pred int, label int, p255 int").withColumn("g", F.lit(1))
    batch = scoring.batch_metrics(rows, ["g"], F.col("pred"), F.col("label")).first()
    assert batch.precision is None and batch.recall == 0 and batch.fbeta is None
    pooled = scoring.pooled(rows, ["g"], F.col("p255"), F.col("label")).first()
    assert pooled.precision == 0 and pooled.f1_aka_dice == 0


def test_thresholds():
    assert scoring.SWEEP_THRESHOLDS[0] == 111 and scoring.SWEEP_THRESHOLDS[-1] == 251 and len(scoring.SWEEP_THRESHOLDS) == 15


def test_run_names(spark):
    names = ["2024-01-02_03.04.05", "x2024-01-02_03.04.05_12", "2024-01-02_03.04.05_summary", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(scalars.is_job_folder(F.col("n")), scalars.fold_number(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(True, -1), (True, 12), (False, -1), (False, -1)]


def test_output_names(spark):
    files = spark.createDataFrame([
        ("r/2024-01-02_03.04.05_3/predictions/a_prediction_b_prediction_1_20_rgb_values.png",),
        ("r/2024-01-02_03.04.05/predictions/a_prediction_final_ink_classes.png",),
        ("r/2024-01-02_03.04.05/predictions/notes.txt",), ("r/misc/predictions/a_prediction_final_ink_classes.png",),
    ], "path string")
    rows = catalog.parse_outputs(files).orderBy("n_from_k_fold", "region_name").select("n_from_k_fold", "region_name", "iteration_str", "prediction_type", "error").collect()
    assert [tuple(r) for r in rows] == [(-1, None, None, None, "name"), (-1, "a", "final", "ink_classes", None), (3, "a_prediction_b", "1_20", "rgb_values", None)]


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(type("Session", (), {"conf": Conf, "sparkContext": Context}))


def test_unknown_label_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown prediction type"):
        spark.createDataFrame([("depth",)], "t string").select(scalars.label_column(F.col("t"))).collect()


def test_paths(spark):
    df = spark.createDataFrame([("../a/./b.png",), ("/x/y",), ("https://h/p",), ("c",), ("../../../../z",)], "p string")
    got = [r[0] for r in df.select(scalars.resolve_path(F.col("p"), F.lit("/d/sets"))).collect()]
    assert got == ["/d/a/b.png", "/x/y", "https://h/p", "/d/sets/c", "/z"]


def test_manifest_lines(spark):
    lists = spark.createDataFrame([("/d/all.txt", "a.json\n\nsub/b.txt\n/abs/c.json\n"), ("/d/sub/b.txt", "a.json\r\nx.bad")], "path string, text string")
    edges = manifests.lines_to_edges(lists)
    roots = spark.createDataFrame([("/d/all.txt", 0)], "path string, ord int")
    rows = manifests.flatten(edges, roots).orderBy("position").collect()
    assert [r.path for r in rows] == ["/d/a.json", "/d/sub/a.json", "/d/sub/x.bad", "/abs/c.json"]
    assert [r.error is not None for r in rows] == [False, False, True, False]


def test_descriptors(spark):
    whole = '{"schema_version": "0.1", "type": "region", "volume": "../v", "ppm": "p.ppm", "mask": null, "invert_normals": true, ' \
            '"bounding_box": [0, 0, 320, 400], "ink_label": "", "rgb_label": null, "volcart_texture_label": null}'
    texts = [
        ("/d/a.json", whole), ("/d/b.json", '{"schema_version": "0.1", "type": "volume", "volume": "v", "volume_bounding_box": [1, 2, 3]}'),
        ("/d/c.json", whole.replace('"0.1"', '"0"').replace("320, 400", "320")), ("/d/d.json", "{"), ("/d/e.json", '{"ppms": {}, "regions": {}}'),
        ("/d/f.json", whole + " trailing"), ("/d/g.json", whole.replace('"../v"', "7")),
    ]
    out = {r.path[-6]: r for r in manifests.parse_descriptors(spark.createDataFrame(texts, "path string, text string")).collect()}
    a = out["a"]
    assert (a.kind, a.errors, a.volume, a.ppm, a.ink_label, a.invert_normals, a.bounding_box) == (
        "region", [], "/v", "/d/p.ppm", None, True, [0, 0, 320, 400])
    assert out["b"].kind == "invalid" and len(out["b"].errors) == 1
    assert len(out["c"].errors) == 2
    assert out["d"].errors == ["not valid JSON"] and out["f"].errors == ["not valid JSON"]
    assert out["e"].kind == "legacy" and out["g"].kind == "invalid"


def test_central_slices_and_turns(spark):
    df = spark.createDataFrame([(list(range(27)),)], "b array<int>")
    planes = df.select(*[c.alias(f"p{i}") for i, c in enumerate(tensors.central_slices(F.col("b"), (3, 3, 3)))]).first()
    cube = np.arange(27).reshape(3, 3, 3)
    assert list(planes) == [cube[1].ravel().tolist(), cube[:, 1].ravel().tolist(), cube[:, :, 1].ravel().tolist()]
    for k in range(4):
        for flip in (False, True):
            turned = df.select(tensors.turn_and_mirror(F.col("b"), (3, 3, 3), k, flip).alias("t"))
            want = np.rot90(cube, k, (1, 2))
            want = np.flip(want, 2) if flip else want
            assert turned.first().t == want.ravel().tolist()
            back = turned.select(tensors.undo_turn_and_mirror(F.col("t"), (3, 3, 3), k, flip)).first()[0]
            assert back == list(range(27))


def test_flat_blocks(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([1.0, 3.0],)], "b array<double>")
    rows = df.select(tensors.standardize(F.col("b")).alias("s"), tensors.min_max(F.col("b")).alias("m")).collect()
    assert rows[0].s == [0.0, 0.0] and rows[0].m is None
    assert np.allclose(rows[1].s, [-0.70710678, 0.70710678]) and rows[1].m == [0.0, 1.0]


def test_two_dimensional_labels():
    block = gather.BlockOptions(shape=(48, 32, 32), augment=True)
    options, patch, spacing = selection.two_dimensional(block)
    assert patch == (32, 32) and spacing == 32 and not options.augment


def test_standard_case_of_closed_and_open_boxes(spark):
    pixels = spark.createDataFrame([Row(px=x, py=0) for x in range(4)])
    box = spark.createDataFrame([(1, 0, 3, 1)], "x0 int, y0 int, x1 int, y1 int")
    assert regions.in_boxes(pixels, box, closed=False).count() == 2
    assert regions.in_boxes(pixels, box, closed=True).count() == 3
