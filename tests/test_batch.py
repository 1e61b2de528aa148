"""Batch scoring of fitted models against numpy on the stored weights."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from voxelsheet.operators import batch, models
from voxelsheet.registry import load_all

SHAPE = (2, 3, 3)
CELLS = 18


@pytest.fixture(scope="module")
def samples(spark):
    draw = np.random.default_rng(2)
    rows = []
    for k in range(300):
        block = draw.normal(size=CELLS)
        rows.append((k, [float(v) for v in block], int(block[:4].sum() + 0.3 * draw.normal() > 0), float(block[0] - block[5]), k % 17, 2 * (k // 17)))
    return spark.createDataFrame(rows, "id int, block array<double>, ink int, texture double, px int, py int").repartition(4)


def by_hand(net, block, averaging):
    """Scores (channels, height, width) of one block, variant by variant."""
    cube = np.array(block).reshape(SHAPE)
    out = []
    for turns in range(4 if averaging else 1):
        for mirror in (False, True) if averaging else (False,):
            turned = np.stack([np.rot90(p, turns) for p in cube])
            turned = turned[:, :, ::-1] if mirror else turned
            value = turned.ravel()
            for n, (w, b) in enumerate(net.layers):
                value = np.array([sum(value[i] * w[i, j] for i in range(len(value))) + b[j] for j in range(len(b))])
                value = value if n == len(net.layers) - 1 else 1 / (1 + np.exp(-value))
            plane = value.reshape(net.channels, *net.plane)
            if net.softmax:
                plane = np.exp(plane - plane.max(0)) / np.exp(plane - plane.max(0)).sum(0)
            plane = plane[:, :, ::-1] if mirror else plane
            out.append(np.stack([np.rot90(c, -turns) for c in plane]))
    return np.mean(out, axis=0)


def random_network(plane, hidden=4, seed=1):
    draw = np.random.default_rng(seed)
    out = 2 * plane[0] * plane[1]
    return batch.Network(((draw.normal(size=(CELLS, hidden)), draw.normal(size=hidden)), (draw.normal(size=(hidden, out)), draw.normal(size=out))), True, 2, plane)


@pytest.mark.parametrize("plane", [(1, 1), (3, 3)])
@pytest.mark.parametrize("averaging", [False, True])
def test_scores_of_any_network(samples, plane, averaging):
    net = random_network(plane)
    rows = batch.predict(samples, "block", net, SHAPE, averaging, rows=37).collect()
    assert len(rows) == 300
    for r in rows[:40]:
        assert np.allclose(r.scores, by_hand(net, r.block, averaging).ravel())


def test_learned_weights_give_the_models_own_scores(spark, samples, tmp_path):
    for name, params in (("ink_classifier", {"maxIter": 30}), ("ink_perceptron", {"layers": [CELLS, 5, 2], "maxIter": 20, "seed": 3})):
        fitted = models.fit(name, samples, "block", **params)
        path = str(tmp_path / name)
        batch.save_network(spark, batch.network(fitted), path)
        net = batch.load_network(spark, path)
        own = {r.id: r.p1 for r in models.score_ink(fitted, samples, "block").collect()}
        got = {r.id: r.p1 for r in batch.ink_scores(batch.predict(samples, "block", net, SHAPE)).collect()}
        assert got.keys() == own.keys() and max(abs(got[k] - own[k]) for k in own) < 1e-9
        blocks = {r.id: r.block for r in samples.collect()}
        assert all(abs(by_hand(net, blocks[k], False)[1, 0, 0] - own[k]) < 1e-9 for k in range(30))
    linear = models.build("rgb_regressor").fit(models.with_features(samples.withColumns({"r": F.col("texture"), "g": F.col("texture") * 2, "b": F.lit(1.0) - F.col("texture")}), "block"))
    scores = batch.predict(samples, "block", batch.network(linear), SHAPE).collect()
    assert all(np.allclose(r.scores, [r.texture, 2 * r.texture, 1 - r.texture], atol=1e-6) for r in scores)
    with pytest.raises(ValueError, match="no weights"):
        batch.network(PipelineModel([batch.IntensityMatchModel(source=[0.0], target=[0.0])]))


def test_train_hold_out_predict(spark, samples):
    """The usual run: learn from some rows, measure on others, write an image of averaged scores."""
    fitted = models.fit("ink_classifier", samples.filter("id % 3 <> 0"), "block", maxIter=50)
    net = batch.network(fitted)
    held = samples.filter("id % 3 = 0").withColumn("batch", F.floor(F.col("id") / 64))
    got = batch.validation(held, "block", net, SHAPE, ["batch"]).first()
    rows = held.collect()
    right = {}
    for r in rows:
        pred = int(by_hand(net, r.block, False)[1, 0, 0] > 0.5)
        right.setdefault(r.batch, []).append(pred == r.ink)
    assert got.accuracy == pytest.approx(np.mean([np.mean(v) for v in right.values()])) and got.accuracy > 0.8
    image = {(r.px, r.py): r.value for r in batch.prediction_image(samples, "block", net, SHAPE, 2, (17, 36), [], ["id"]).collect()}
    want = {}
    for r in sorted(samples.collect(), key=lambda r: r.id):
        value = int(by_hand(net, r.block, True)[1, 0, 0] * 65535)
        for dy in (-1, 0):
            for dx in (-1, 0):
                if 0 <= r.px + dx < 17 and 0 <= r.py + dy < 36:
                    want[r.px + dx, r.py + dy] = value
    assert image.keys() == want.keys() and max(abs(image[k] - want[k]) for k in want) <= 1


def test_planes_are_written_around_their_points(samples):
    net = random_network((3, 3))
    few = samples.filter("id < 40")
    image = {(r.px, r.py): r.value for r in batch.prediction_image(few, "block", net, SHAPE, 3, (17, 36), [], ["id"]).collect()}
    want = {}
    for r in sorted(few.collect(), key=lambda r: r.id):
        plane = by_hand(net, r.block, True)[1]
        for y in range(3):
            for x in range(3):
                if 0 <= r.px - 1 + x < 17 and 0 <= r.py - 1 + y < 36:
                    want[r.px - 1 + x, r.py - 1 + y] = int(plane[y, x] * 65535)
    assert image.keys() == want.keys() and max(abs(image[k] - want[k]) for k in want) <= 1


def test_transform_ahead_of_the_model(samples):
    net = random_network((1, 1))
    got = batch.ink_scores(batch.predict(samples, "block", net, SHAPE, before=lambda b: 2 * b)).collect()
    assert all(r.p1 == pytest.approx(by_hand(net, [2 * v for v in r.block], False)[1, 0, 0]) for r in got[:20])


def test_centroids(samples):
    rows = samples.collect()
    means = [np.mean([r.block for r in rows if r.ink == k], axis=0) for k in (0, 1)]
    net = batch.centroid_network(samples, "block")
    for r in rows[:30]:
        nearer = np.linalg.norm(np.array(r.block) - means[1]) < np.linalg.norm(np.array(r.block) - means[0])
        assert (by_hand(net, r.block, False)[1, 0, 0] > 0.5) == nearer
    with pytest.raises(ValueError, match="both classes"):
        batch.centroid_network(samples.filter("ink = 1"), "block")


def test_intensity_stage_in_a_pipeline(spark, samples, tmp_path):
    rows = samples.withColumn("other", F.col("id") % 2 == 0).withColumn("block", F.when(F.col("other"), F.transform("block", lambda v: v * 3 + 1)).otherwise(F.col("block")))
    stage = batch.IntensityMatch(inputCol="block", outputCol="mapped", domainCol="other", knots=33)
    fitted = Pipeline(stages=[stage]).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[0].getOrDefault("source") == fitted.stages[0].getOrDefault("source") and len(again.stages[0].getOrDefault("target")) == 33
    before, after = ({r.id: r.mapped for r in m.transform(rows).collect()} for m in (fitted, again))
    assert before == after
    mapped = np.concatenate([v for k, v in after.items() if k % 2 == 0])
    kept = np.concatenate([v for k, v in after.items() if k % 2])
    assert abs(mapped.mean() - kept.mean()) < 0.1 and abs(mapped.std() - kept.std()) < 0.1
    unfitted = Pipeline(stages=[stage])
    unfitted.write().overwrite().save(str(tmp_path / "e"))
    assert Pipeline.load(str(tmp_path / "e")).getStages()[0].getOrDefault("knots") == 33


def test_trained_queries_repeat_their_numbers(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("trained_image", "trained_validation", "texture_trained"):
        first, second = (sorted(map(tuple, load_all()[name].run(spark, folder).collect())) for _ in range(2))
        assert first == second and first
