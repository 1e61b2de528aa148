"""Quantile sketches, folds fitted side by side, and labelled patches by hand."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelsheet.functions import chance
from voxelsheet.operators import models, patches, sketches, stacks


@pytest.fixture(scope="module")
def slices(spark):
    rows = spark.range(120_000).select((F.col("id") % 3).cast("int").alias("z"), F.floor(F.exp(F.randn(3) * 2) * 1000).cast("bigint").alias("v"))
    return rows.cache()


def ranks(values, found):
    """Least and greatest share of ranks that a value takes."""
    return np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)


@pytest.mark.parametrize("k", [200, 800])
def test_quantiles_are_within_the_rank_error(slices, k):
    shares = {f"q{i}": i / 20 for i in range(1, 20)}
    held = sketches.slice_sketches(slices.repartition(7), ["z"], "v", k)
    data = {z: np.sort([r.v for r in slices.filter(F.col("z") == z).collect()]) for z in range(3)}
    for row in sketches.quantiles(held, shares).collect():
        assert row.n == 40_000 and len(row.sketch) < 60 * k
        for name, share in shares.items():
            low, high = ranks(data[row.z], row[name])
            assert low - 1.5 * sketches.rank_error(k) <= share <= high + 1.5 * sketches.rank_error(k)
    every = np.sort(np.concatenate(list(data.values())))
    whole = sketches.quantiles(sketches.merged(held.withColumn("g", F.lit(0)), ["g"], k), shares).first()
    assert whole.n == 120_000
    for name, share in shares.items():
        low, high = ranks(every, whole[name])
        assert low - 1.5 * sketches.rank_error(k) <= share <= high + 1.5 * sketches.rank_error(k)


def test_short_slices_are_exact_and_empty_ones_null(spark):
    rows = spark.createDataFrame([(0, 5), (0, 1), (0, 9), (1, None), (2, 7)], "z int, v int")
    got = {r.z: (r.n, r.a, r.b) for r in sketches.quantiles(sketches.slice_sketches(rows, ["z"], "v"), {"a": 0.5, "b": 1.0}).collect()}
    assert got == {0: (3, 5, 9), 1: (0, None, None), 2: (1, 7, 7)}


def test_windows_are_near_the_exact_ones(spark, slices):
    held = sketches.slice_sketches(slices, ["z"], "v")
    draws = spark.createDataFrame([(0,), (1,), (1,), (2,), (0,)], "z int")
    exact = stacks.auto_window(slices, ["z"], "v", 5, 95, 4096, draws).first()
    near = sketches.window(held, 0.05, 0.95, draws, ["z"]).first()
    assert near.window_min == pytest.approx(exact.window_min, rel=0.1) and near.window_max == pytest.approx(exact.window_max, rel=0.1)


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    draw = np.random.default_rng(0)
    rows = [(k, [float(v) for v in draw.normal(size=3)]) for k in range(120)]
    samples = spark.createDataFrame([(k, b, int(b[0] > 0)) for k, b in rows], "id bigint, block array<double>, ink int")
    spans, fit = [], models.fit

    def timed(*args, **params):
        began = time.monotonic()
        barrier.wait(60)  # every fit is under way before one goes on
        out = fit(*args, **params)
        spans.append((began, time.monotonic()))
        return out

    barrier = threading.Barrier(3)
    monkeypatch.setattr(models, "fit", timed)
    fold = chance.draw(1, "id", portable=True) % 3
    scored = models.fold_scores("ink_classifier", samples, fold, 3, "block", ["id"], maxIter=5).collect()
    assert len(scored) == 120 and max(b for b, _ in spans) < min(e for _, e in spans)
    monkeypatch.setattr(models, "fit", fit)
    marked = samples.withColumn("fold", fold)
    for n in range(3):
        alone = models.score_ink(fit("ink_classifier", marked.filter(F.col("fold") != n), "block", maxIter=5), marked.filter(F.col("fold") == n), "block")
        want = {r.id: r.p1 for r in alone.collect()}
        got = {r.id: r.p1 for r in scored if r.fold == n}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("layout", ["grey", "rgb"])
def test_labelled_patches_by_hand(spark, layout):
    draw = np.random.default_rng(5)
    depth, height, width, p, stride = 3, 11, 9, 4, 3
    stacks_, labels = {i: draw.integers(0, 65536, (depth, height, width)) for i in (0, 2)}, {}
    features = spark.createDataFrame([(i, c, y, x, int(s[c, y, x])) for i, s in stacks_.items() for c, y, x in np.ndindex(s.shape)], "image int, channel int, py int, px int, v int")
    planes = 1 if layout == "grey" else 3
    for i in stacks_:
        labels[i] = draw.integers(0, 256, (planes, height, width))
    pictures = [(i, y, x, *[int(v) for v in labels[i][:, y, x]]) for i in labels for y, x in np.ndindex(height, width)]
    frame = spark.createDataFrame(pictures, "image int, py int, px int, " + ("v int" if layout == "grey" else "r int, g int, b int"))
    first = patches.channel_first(frame, layout)
    assert patches.stack_faults(features, first).isEmpty()
    got = {(r.image, r.patch_y, r.patch_x): r for r in patches.labelled_patches(features, first, p, stride, depth, planes).collect()}
    assert set(got) == {(i, y, x) for i in stacks_ for y in range(0, height, stride) for x in range(0, width, stride)}
    for (i, y, x), r in got.items():
        feature, label = np.zeros((depth, p, p)), np.zeros((planes, p, p), int)
        a, b = stacks_[i][:, y:y + p, x:x + p], labels[i][:, y:y + p, x:x + p]
        feature[:, :a.shape[1], :a.shape[2]] = a / 65535
        label[:, :b.shape[1], :b.shape[2]] = b
        assert np.allclose(r.feature, feature.ravel()) and r.label == label.ravel().tolist()
    alone = patches.labelled_patches(features, None, p, stride, depth).first()
    assert alone.label is None and len(alone.feature) == depth * p * p


def test_stack_faults(spark):
    def picture(image, depth, height, width):
        return [(image, c, y, x, 1) for c in range(depth) for y in range(height) for x in range(width)]

    schema = "image int, channel int, py int, px int, v int"
    features = spark.createDataFrame(picture(0, 3, 4, 5) + picture(1, 3, 4, 5) + picture(2, 3, 4, 4) + picture(3, 2, 4, 5) + picture(4, 3, 4, 5), schema)
    labels = spark.createDataFrame(picture(0, 1, 4, 5) + picture(2, 1, 4, 5) + picture(3, 3, 4, 5) + picture(4, 2, 4, 5), schema)
    assert {r.image: r.fault for r in patches.stack_faults(features, labels).collect()} == {1: "label", 2: "size", 3: "depth", 4: "channels"}
    with pytest.raises(ValueError, match="layout"):
        patches.channel_first(features, "cmyk")
