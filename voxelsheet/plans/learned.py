"""Queries that fit a model and run it: scores, averages over turned copies, images, validation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..functions import chance, tensors
from ..operators import batch, gather, models
from ..registry import query
from ..session import scratch_path
from .samples import KEYS, NEAREST, PLACED, SELECTED, cells_sql, chosen_points

SHAPE = (4, 4, 4)
FOLD = "(vec_id * 1103515245 + 12412) % 2147483648 % 3"

# The nearer of two class means, learned from two of three folds.
CENTROIDS = f"""
samples as (select *, {FOLD} as fold, list_transform(embedding[1:64], lambda v: cast(v as double)) as e from feat),
means as (select i.i as i, avg(case when ink = 1 then e[i.i + 1] end) as m1, avg(case when ink = 0 then e[i.i + 1] end) as m0
          from samples, range(64) i(i) where fold <> 0 group by i.i),
bias as (select sum(m0 * m0 - m1 * m1) / 2 as b from means)"""

PLAIN = f"{CENTROIDS}, scored as (select vec_id, ink, label, fold, 1e0 / (1e0 + exp(-(sum((m1 - m0) * e[i + 1]) + any_value(b)))) as p1 from samples, means, bias group by vec_id, ink, label, fold)"

AVERAGED = f"""{CENTROIDS},
variants as (select k, m, z * 16 + i * 4 + j as cell, z * 16 + case k when 0 then i when 1 then jj when 2 then 3 - i else 3 - jj end * 4
                    + case k when 0 then jj when 1 then 3 - i when 2 then 3 - jj else i end as other
             from (select k.k, m.m, z.z, i.i, j.j, case when m = 1 then 3 - j else j end as jj from range(4) k(k), range(2) m(m), range(4) z(z), range(4) i(i), range(4) j(j)) q),
turned as (select vec_id, k, m, sum((m1 - m0) * e[other + 1]) + any_value(b) as s from samples, variants, means, bias where means.i = cell group by vec_id, k, m),
scored as (select vec_id, avg(1e0 / (1e0 + exp(-s))) as p1 from turned group by vec_id)"""


def marked(t):
    return t.feat.withColumn("fold", chance.draw(1, "vec_id", portable=True) % 3)


def centroids(t):
    """Fitted on two folds, saved and loaded again."""
    path = scratch_path(t.spark, "network")
    batch.save_network(t.spark, batch.centroid_network(marked(t).filter("fold <> 0"), "embedding"), path)
    return batch.load_network(t.spark, path)


def logistic(t):
    fitted = models.fit("ink_classifier", marked(t).filter("fold <> 0"), "embedding", maxIter=50)
    path = scratch_path(t.spark, "network")
    batch.save_network(t.spark, batch.network(fitted), path)
    return batch.load_network(t.spark, path)


@query("centroid_scores", "vec_id:l p1:d", f"with {PLAIN} select vec_id, round(p1, 9) as p1 from scored", "feat")
def _(t):
    """A fitted model's scores of every sample."""
    scored = batch.ink_scores(batch.predict(t.feat, "embedding", centroids(t), SHAPE))
    return scored.withColumn("p1", F.round("p1", 9))


@query("centroid_averaged", "vec_id:l p1:d", f"with {AVERAGED} select vec_id, round(p1, 9) as p1 from scored", "feat")
def _(t):
    """The same over turned and mirrored copies."""
    scored = batch.ink_scores(batch.predict(t.feat, "embedding", centroids(t), SHAPE, averaging=True))
    return scored.withColumn("p1", F.round("p1", 9))


def placed_samples(t):
    """Samples at surface pixels, as a prediction region would list them."""
    width, height = t.surface_size
    return t.feat.select("vec_id", "embedding", (F.col("vec_id") % width).cast("int").alias("px"),
                         F.pmod(F.floor(F.col("vec_id") / width) * 4, F.lit(height)).cast("int").alias("py"))


IMAGE = """
w as (select cast(max(px) as bigint) + 1 as width, cast(max(py) as bigint) + 1 as height from surface),
spots as (select vec_id, cast(trunc(p1 * 65535) as bigint) as v, vec_id % width as cx, cast(floor(vec_id / cast(width as double)) as bigint) * 4 % height as cy, width, height from scored, w),
top as (select * from (select *, row_number() over (partition by cx, cy order by vec_id desc) as rn from spots) q where rn = 1),
cells as (select cx + dx - 2 as px, cy + dy - 2 as py, vec_id, v, width, height from top, range(4) a(dx), range(4) b(dy))
select px, py, v as value from (select *, row_number() over (partition by px, py order by vec_id desc) as rn from cells where px >= 0 and py >= 0 and px < width and py < height) q where rn = 1"""


@query("centroid_image", "px:l py:l value:l", f"with {AVERAGED}, {IMAGE}", "feat surface")
def _(t):
    """A prediction image end to end: fit, score turned copies, average, write back around the points."""
    return batch.prediction_image(placed_samples(t), "embedding", centroids(t), SHAPE, 4, t.surface_size, [], ["vec_id"])


@query("trained_image", "px:l py:l value:l")
def _(t):
    """The same with a logistic model, whose weights SQL cannot find; checked against numpy on the stored weights."""
    return batch.prediction_image(placed_samples(t), "embedding", logistic(t), SHAPE, 4, t.surface_size, [], ["vec_id"])


VALIDATION = """
c as (select cast(floor(vec_id / 64.0) as bigint) as batch, p1 > 1 - p1 as pred, ink = 1 as truth from scored where fold = 0),
per as (select batch, avg(case when pred = truth then 1e0 else 0e0 end) as accuracy, count_if(pred and truth) / nullif(count_if(pred), 0) as precision,
        count_if(pred and truth) / nullif(count_if(truth), 0) as recall, count_if(pred) as preds, count_if(truth) as labels from c group by batch)
select round(avg(accuracy), 9) as accuracy, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, sum(preds) as positive_preds_sum, sum(labels) as positive_labels_sum from per"""


def held_out(t):
    return marked(t).filter("fold = 0").withColumn("batch", F.floor(F.col("vec_id") / 64))


def rolled(scored):
    return scored.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")], "positive_preds_sum", "positive_labels_sum")


@query("centroid_validation", "accuracy:d precision:d recall:d positive_preds_sum:d positive_labels_sum:d", f"with {PLAIN}, {VALIDATION}", "feat")
def _(t):
    """Metrics of a fitted model on the fold it did not see."""
    return rolled(batch.validation(held_out(t), "embedding", centroids(t), SHAPE, ["batch"]))


@query("trained_validation", "accuracy:d precision:d recall:d positive_preds_sum:d positive_labels_sum:d")
def _(t):
    return rolled(batch.validation(held_out(t), "embedding", logistic(t), SHAPE, ["batch"]))


@query("texture_from_scores", "vec_id:l texture:d", f"""
with {PLAIN}, fit as (select regr_slope(label / 10e0, p1) as a, regr_intercept(label / 10e0, p1) as c from scored where fold <> 0)
select vec_id, round(a * p1 + c, 6) as texture from scored, fit""", "feat")
def _(t):
    """Texture by a linear model on the ink scores of a fitted classifier."""
    scored = batch.ink_scores(batch.predict(marked(t), "embedding", centroids(t), SHAPE)).withColumn("texture", F.col("label") / 10.0)
    fitted = models.build("texture_head", scores="p1", regParam=0.0, solver="normal").fit(scored.filter("fold <> 0"))
    return fitted.transform(scored).select("vec_id", F.round("texture_pred", 6).alias("texture"))


@query("texture_trained", "vec_id:l texture:d")
def _(t):
    """Classifier and texture model fitted as one pipeline, both run on samples."""
    rows = models.with_features(marked(t), "embedding").withColumn("texture", F.col("label") / 10.0)
    fitted = models.build("texture_from_ink").fit(rows.filter("fold <> 0"))
    return fitted.transform(rows).select("vec_id", F.round("texture_pred", 6).alias("texture"))


@query("intensity_stage", "vec_id:l total:d", """
with cells as (select ink, unnest(embedding) as v from feat), shares(s) as (select i / 16e0 from range(17) r(i)),
knots as (select ink, list(k order by s) as ks from (select ink, s, cast(list_sort(list(v))[greatest(1, cast(ceil(s * count(*)) as bigint))] as double) as k from cells, shares group by ink, s) q group by ink),
moved as (select vec_id, f.ink, i, cast(embedding[i] as double) as v, a.ks as src, b.ks as dst from (select *, unnest(range(1, len(embedding) + 1)) as i from feat) f, knots a, knots b where a.ink = 1 and b.ink = 0),
placed as (select *, list_position(list_transform(src[2:17], lambda x: v <= x), true) as j from moved)
select vec_id, round(sum(case when ink = 0 then v when v <= src[1] then dst[1] when j is null or j = 0 then dst[17] when src[j + 1] = src[j] then dst[j]
       else dst[j] + (v - src[j]) * ((dst[j + 1] - dst[j]) / (src[j + 1] - src[j])) end), 4) as total from placed group by vec_id""", "feat")
def _(t):
    """The intensity transfer as a stage of a pipeline, saved and loaded before it is used."""
    rows = t.feat.withColumn("other_scan", F.col("ink") == 1)
    stage = batch.IntensityMatch(inputCol="embedding", outputCol="block", domainCol="other_scan")
    path = scratch_path(t.spark, "pipeline")
    Pipeline(stages=[stage]).fit(rows).write().overwrite().save(path)
    moved = PipelineModel.load(path).transform(rows)
    return moved.select("vec_id", F.round(tensors.total(F.col("block")), 4).alias("total"))


@query("model_inputs_all_options", "face_id:l px:l py:l weighted:d top_v:d", f"""
with {SELECTED}, {PLACED}, {cells_sql(2, 2, 2)}, {NEAREST},
ready as (select face_id, px, py, cell, floor(least(greatest((v - 1000e0) / (50000e0 - 1000e0) * 65535e0, 0e0), 65535e0)) / 65535e0 as u,
                 ((py * 50 + px) * 1103515245 + 3 * 12345 + 67) % 2147483648 as bits from gathered),
moved as (select face_id, px, py, (cell // 4) * 4 + case when (bits // 2048) % 2 = 1 then 1 - cell // 2 % 2 else cell // 2 % 2 end * 2
                 + case when (bits // 1024) % 2 = 1 then 1 - cell % 2 else cell % 2 end as cell, (u - 0.5e0) / 0.5e0 as u from ready),
about as (select face_id, px, py, avg(u) as m, stddev_samp(u) as d from moved group by all)
select face_id, px, py, round(sum((u - m) / case when d < 1e-12 then 1 else d end * (cell + 1)), 5) as weighted, round(max((u - m) / case when d < 1e-12 then 1 else d end), 5) as top_v
from moved join about using (face_id, px, py) group by face_id, px, py""", "voxels surface raster")
def _(t):
    """Window, flips and standardising, all of them, in the order the model inputs are made."""
    options = gather.BlockOptions(shape=(2, 2, 2), window=(1000.0, 50000.0), augment=True, standardize=True, seed=3)
    points = chosen_points(t).withColumn("point_id", F.col("py").cast("bigint") * 50 + F.col("px"))
    keys = [*KEYS, "point_id"]
    blocks = gather.as_blocks(gather.gather(points, t.voxels, keys, options, t.volume_shape), keys, options.cells)
    ready = blocks.withColumn("block", gather.finish_block(F.col("block"), options, ["point_id"], portable=True))
    weighted = F.aggregate(F.transform("block", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return ready.select(*KEYS, F.round(weighted, 5).alias("weighted"), F.round(F.array_max("block"), 5).alias("top_v"))
