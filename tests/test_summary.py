"""Metrics of every iteration from changes, against merging every face by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxelsheet.operators import scoring, summary


def cases(spark, seed):
    draw = random.Random(seed)
    width, height, regions = 12, 6, 4
    boxes = {r: (draw.randrange(6), 0, draw.randrange(7, 13), draw.randrange(2, 7)) for r in range(regions)}
    if seed == 2:
        boxes[1] = (None,) * 4  # no box: whole
    images = []
    for r in range(regions):
        for epoch, batch in draw.sample([(e, b) for e in range(3) for b in (0, 7)], draw.randrange(1, 6)):
            images += [(r, epoch, batch, x, y, draw.randrange(256), *boxes[r]) for x in range(width) for y in range(height) if draw.random() < 0.7]
    raster = [(x, y, 255 if draw.random() < 0.9 else 0, 255 if draw.random() < 0.4 else 0) for x in range(width) for y in range(height)]
    squares = [(0, 0, 5, 5), (4, 2, 11, 5)]
    return (images, raster, squares,
            spark.createDataFrame(images, "region int, epoch int, batch int, px int, py int, p255 int, x0 int, y0 int, x1 int, y1 int"),
            spark.createDataFrame(raster, "px int, py int, mask int, ink int"), spark.createDataFrame(squares, "x0 int, y0 int, x1 int, y1 int"))


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_metrics_per_iteration(spark, seed):
    images, raster, squares, frame, masks, boxes = cases(spark, seed)
    listed = frame.select("region", "epoch", "batch").distinct()
    got = {(r.epoch, r.batch): r for r in summary.metrics_per_iteration(frame.repartition(5), listed, masks, boxes).collect()}
    by_image = defaultdict(dict)
    for r, e, b, x, y, v, *box in images:
        by_image[r, (e, b)][x, y] = (v, box)
    truth = {(x, y): ink for x, y, mask, ink in raster if mask}
    wanted = {}
    for at in sorted({k for _, k in by_image}):
        latest = {r: max(k for q, k in by_image if q == r and k <= at) for r in {q for q, k in by_image if k <= at}}
        face = {}
        for r in sorted(latest):
            for pixel, (v, (x0, y0, x1, y1)) in by_image[r, latest[r]].items():
                if r == min(latest) or x0 is None or (x0 <= pixel[0] < x1 and y0 <= pixel[1] < y1):
                    face[pixel] = v
        rows = [(face[p], int(truth[p] > 0)) for p in face if p in truth for a, b, c, d in squares if a <= p[0] <= c and b <= p[1] <= d]
        if rows:
            wanted[at] = rows
    assert got.keys() == wanted.keys() and got
    schema = "p255 int, label int"
    for at, rows in wanted.items():
        plain = scoring.pooled(spark.createDataFrame(rows, schema).withColumn("k", F.lit(0)), ["k"], F.col("p255"), F.col("label")).first()
        for name in ("cross_entropy_on_scores", "precision", "recall", "false_positive_rate", "f1_aka_dice", "f05"):
            assert getattr(got[at], name) == pytest.approx(getattr(plain, name), abs=1e-9), (at, name)


def test_spans(spark):
    listed = spark.createDataFrame([(2, 0, 5), (2, 1, 0), (1, 1, 3), (3, 0, 1), (0, 9, 9)], "region int, epoch int, batch int")
    step = summary.EPOCH_STEP
    got = {(r.region, r.k): (r.until, r.first_from, r.first_until) for r in summary.image_spans(listed).collect()}
    assert got == {(2, 5): (step, 5, step + 3), (2, step): (summary.NEVER, 5, step + 3), (1, step + 3): (summary.NEVER, step + 3, 9 * step + 9),
                   (3, 1): (summary.NEVER, 1, 5), (0, 9 * step + 9): (summary.NEVER, 9 * step + 9, summary.NEVER)}


def test_no_pixel_and_no_image(spark):
    _, _, _, frame, masks, boxes = cases(spark, 0)
    listed = frame.select("region", "epoch", "batch").distinct()
    assert summary.metrics_per_iteration(frame, listed, masks.filter("false"), boxes).count() == 0
    assert summary.metrics_per_iteration(frame.filter("false"), listed.filter("false"), masks, boxes).count() == 0
