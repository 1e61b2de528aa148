"""Queries over training logs, models, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chance
from ..operators import models, training
from ..registry import query
from ..session import scratch_path
from ..streaming import jobs
from .evaluation import WRITE_ORDER
from .stacks import SIX_SQL, six_extremes

LOG = """
log as (select *, case when batch % 50 = 0 then 1 else 0 end as flag from metrics),
windowed as (select *, coalesce(sum(flag) over (partition by job order by step rows between unbounded preceding and 1 preceding), 0) as report from log)"""


@query("report_windows", "job:l step:l report:l", f"with {LOG} select job, step, report from windowed", "metrics")
def _(t):
    return training.report_windows(t.metrics, ["job"], "step", "batch", 50, bucket_width=2048)


@query("report_values", "job:l report:l metric:s value:d", f"""
with {LOG}, named as (select *, case when metric = 'click' then 'click_sum' else metric end as name from windowed)
select job, report, name as metric, case when contains(name, 'sum') then sum(value100) else round(avg(value100), 6) end as value from named group by job, report, name""", "metrics")
def _(t):
    windows = training.report_windows(t.metrics, ["job"], "step", "batch", 50, bucket_width=2048)
    named = windows.withColumn("metric", F.when(F.col("metric") == "click", "click_sum").otherwise(F.col("metric")))
    return training.report_values(named, ["job"], "metric", "value100").withColumn("value", F.round("value", 6))


@query("checkpoint_rows", "job:l step:l", "select job, step from metrics where batch % 200 = 0", "metrics")
def _(t):
    return training.checkpoints(t.metrics, "batch", 200)


@query("trailing_half", "user_id:l last:d low:d high:d", """
with v as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n from events)
select user_id, max(case when rn = n then value end) as last, min(value) as low, max(value) as high from v where rn > n // 2 group by user_id""")
def _(t):
    return training.trailing_half(t.raw("events"), ["user_id"], "event_id", "value", bucket_width=4096)


# --- models ------------------------------------------------------------------------

SHAPE = (4, 4, 4)


def in_range():
    return F.col("p1").between(0, 1).alias("in_range")


@query("ink_classifier", "vec_id:l ink:l in_range:b optimal:b", "select vec_id, ink, true as in_range, true as optimal from feat", "feat")
def _(t):
    """One probability per sample, from weights at which the likelihood's gradient vanishes."""
    model = models.fit("ink_classifier", t.feat, "embedding", maxIter=200, tol=1e-10)
    scored = models.score_ink(model, t.feat, "embedding")
    gradient = models.optimality(scored, "embedding").scalar()
    return scored.select("vec_id", "ink", in_range(), (gradient < 1e-3).alias("optimal"))


@query("ink_averaged", "vec_id:l p1:d", """
with b as (select vec_id, list_transform(embedding[1:64], lambda v: cast(v as double)) as e from feat)
select vec_id, round((e[1] + e[4] + e[13] + e[16]) / 4, 5) as p1 from b""", "feat")
def _(t):
    """Test-time averaging; the score is a corner cell, so the mean is that of the four corners of its plane."""
    corner = lambda rows, block: rows.withColumn("p1", F.element_at(block, 1).cast("double"))
    return models.score_averaged(corner, t.feat, "embedding", SHAPE, ["vec_id"]).withColumn("p1", F.round("p1", 5))


@query("saved_model", "vec_id:l same:b", "select vec_id, true as same from feat", "feat")
def _(t):
    """A model saved and loaded again gives the same scores."""
    path = scratch_path(t.spark, "model")
    fitted = models.fit("ink_classifier", t.feat, "embedding", maxIter=10)
    models.save(fitted, path)
    again = models.score_ink(models.load(path), models.score_ink(fitted, t.feat, "embedding").withColumnRenamed("p1", "before"), "embedding")
    return again.select("vec_id", (F.col("before") == F.col("p1")).alias("same"))


GIVEN = "given as (select vec_id, ink, (vec_id * 37 + label * 11) % 101 / 100e0 as p1, cast(floor(vec_id / 64.0) as bigint) as batch from feat)"


def given_scores(t):
    """Scores from a table instead of a model."""
    p1 = F.pmod(F.col("vec_id") * 37 + F.col("label") * 11, F.lit(101)) / 100.0
    return t.feat.withColumns({"p1": p1, "batch": F.floor(F.col("vec_id") / 64)})


@query("validation_pass", "accuracy:d precision:d recall:d positive_preds_sum:d positive_labels_sum:d", f"""
with {GIVEN}, c as (select batch, p1 > 1 - p1 as pred, ink = 1 as truth from given),
per as (select batch, avg(case when pred = truth then 1e0 else 0e0 end) as accuracy, count_if(pred and truth) / nullif(count_if(pred), 0) as precision,
        count_if(pred and truth) / nullif(count_if(truth), 0) as recall, count_if(pred) as preds, count_if(truth) as labels from c group by batch)
select round(avg(accuracy), 9) as accuracy, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, sum(preds) as positive_preds_sum, sum(labels) as positive_labels_sum from per""", "feat")
def _(t):
    rolled = models.validate(given_scores(t), ["batch"])
    return rolled.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")], "positive_preds_sum", "positive_labels_sum")


@query("kfold_scores", "vec_id:l fold:l held_out:b in_range:b", """
select vec_id, (vec_id * 1103515245 + 12412) % 2147483648 % 3 as fold, true as held_out, true as in_range from feat""", "feat")
def _(t):
    """Every sample once, scored by a model that did not see its fold."""
    fold = chance.draw(1, "vec_id", portable=True) % 3
    scored = models.fold_scores("ink_classifier", t.feat, fold, 3, "embedding", ["vec_id"], maxIter=10)
    return scored.select("vec_id", "fold", (F.col("fold") == fold).alias("held_out"), in_range())


@query("rgb_regressor", "vec_id:l r:d g:d b:d", """
select vec_id, round(0.5e0 * cast(embedding[1] as double) + 0.25e0, 4) as r, round(cast(embedding[2] as double) - cast(embedding[3] as double), 4) as g, round(0.75e0 - 2e0 * cast(embedding[4] as double), 4) as b from feat""", "feat")
def _(t):
    """Targets are linear in the inputs, so the fit returns them."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    rows = t.feat.select("vec_id", "embedding", (e(1) * 0.5 + 0.25).alias("r"), (e(2) - e(3)).alias("g"), (F.lit(0.75) - e(4) * 2).alias("b"))
    fitted = models.fit("rgb_regressor", rows, "embedding", regParam=0.0)
    out = fitted.transform(models.with_features(rows, "embedding"))
    return out.select("vec_id", *[F.round(f"{c}_pred", 4).alias(c) for c in "rgb"])


@query("texture_from_ink", "vec_id:l texture:d", f"with {GIVEN} select vec_id, round(0.2e0 + 0.6e0 * p1, 6) as texture from given", "feat")
def _(t):
    """Texture linear in the ink score, which comes from a table."""
    rows = given_scores(t).withColumn("texture", F.lit(0.2) + F.col("p1") * 0.6)
    fitted = models.build("texture_head", scores="p1").fit(rows)
    return fitted.transform(rows).select("vec_id", F.round("texture_pred", 6).alias("texture"))


@query("reconstruction", "vec_id:l mse:d", "select vec_id, 0e0 as mse from feat", "feat")
def _(t):
    """With as many components as cells nothing is lost."""
    cells = t.feat.select(F.size("embedding")).first()[0]
    rebuilt = models.reconstruct(models.fit("autoencoder", t.feat, "embedding", k=cells), t.feat, "embedding", ["vec_id"])
    return rebuilt.select("vec_id", F.round("mse", 9).alias("mse"))


@query("reconstruction_truncated", "vec_id:l mse:d")
def _(t):
    """Lossy: eight components by a randomised decomposition."""
    mean, basis = models.randomized_basis(t.feat, "embedding", 8)
    return models.reconstruct_truncated(mean, basis, t.feat, "embedding", ["vec_id"]).drop("rebuilt")


@query("intensity_transfer", "vec_id:l total:d", """
with cells as (select ink, unnest(embedding) as v from feat), shares(s) as (select i / 16e0 from range(17) r(i)),
knots as (select ink, list(k order by s) as ks from (select ink, s, cast(list_sort(list(v))[greatest(1, cast(ceil(s * count(*)) as bigint))] as double) as k from cells, shares group by ink, s) q group by ink),
moved as (select vec_id, i, cast(embedding[i] as double) as v, a.ks as src, b.ks as dst from (select *, unnest(range(1, len(embedding) + 1)) as i from feat) f, knots a, knots b where a.ink = 1 and b.ink = 0),
placed as (select *, list_position(list_transform(src[2:17], lambda x: v <= x), true) as j from moved)
select vec_id, round(sum(case when v <= src[1] then dst[1] when j is null or j = 0 then dst[17] when src[j + 1] = src[j] then dst[j]
       else dst[j] + (v - src[j]) * ((dst[j + 1] - dst[j]) / (src[j + 1] - src[j])) end), 4) as total from placed group by vec_id""", "feat")
def _(t):
    """Intensities of ink samples mapped to those of the others, ahead of a model."""
    from ..functions import tensors

    source = models.quantile_knots(t.feat.filter("ink = 1"), "embedding")
    target = models.quantile_knots(t.feat.filter("ink = 0"), "embedding")
    moved = t.feat.select("vec_id", models.match_intensity(F.col("embedding"), source, target).alias("block"))
    return moved.select("vec_id", F.round(tensors.total(F.col("block")), 4).alias("total"))


@query("scores_on_surface", "px:l py:l value:l", f"""
with {GIVEN}, w as (select cast(max(px) as bigint) + 1 as width, cast(max(py) as bigint) + 1 as height from surface),
spots as (select vec_id, cast(trunc(p1 * 65535) as bigint) as v, vec_id % width as cx, cast(floor(vec_id / cast(width as double)) as bigint) * 4 % height as cy, width, height from given, w),
top as (select * from (select *, row_number() over (partition by cx, cy order by vec_id desc) as rn from spots) q where rn = 1),
cells as (select cx + dx - 2 as px, cy + dy - 2 as py, vec_id, v, width, height from top, range(4) a(dx), range(4) b(dy))
select px, py, v as value from (select *, row_number() over (partition by px, py order by vec_id desc) as rn from cells where px >= 0 and py >= 0 and px < width and py < height) q where rn = 1""", "feat surface")
def _(t):
    """Samples at surface pixels, scored and stamped over 4 x 4 squares."""
    width, height = t.surface_size
    placed = given_scores(t).select("p1", "vec_id", (F.col("vec_id") % width).cast("int").alias("px"), F.pmod(F.floor(F.col("vec_id") / width) * 4, F.lit(height)).cast("int").alias("py"))
    return models.write_back(placed, 4, width, height, [], ["vec_id"])


@query("plane_predictions", "px:l py:l value:d", """
with w as (select cast(max(px) as bigint) + 1 as width, cast(max(py) as bigint) + 1 as height from surface),
cells as (select vec_id, i, cast(embedding[i + 1] as double) as v, vec_id % width + i % 4 - 2 as px, cast(floor(vec_id / cast(width as double)) as bigint) * 4 % height + i // 4 - 2 as py, width, height
  from (select *, unnest(range(16)) as i from feat) f, w)
select px, py, round(v, 5) as value from (select *, row_number() over (partition by px, py order by vec_id desc, v desc) as rn from cells where px >= 0 and py >= 0 and px < width and py < height) q where rn = 1""",
       "feat surface")
def _(t):
    """Planes of 4 x 4 predictions, averaged over turned and mirrored inputs, written around their points.

    The prediction of a block is its first plane, so the average over all variants is that plane again.
    """
    from ..operators import augment, stamps

    width, height = t.surface_size
    rows = augment.variant_rows(t.feat.select("vec_id", "embedding"), "embedding", SHAPE)
    scored = rows.withColumn("plane", F.transform(F.slice("embedding", 1, 16), lambda v: v.cast("double")))
    planes = augment.merge_planes(scored, ["vec_id"], "plane", (4, 4))
    placed = planes.select("vec_id", "plane", (F.col("vec_id") % width).cast("int").alias("px"), F.pmod(F.floor(F.col("vec_id") / width) * 4, F.lit(height)).cast("int").alias("py"))
    written = stamps.stamp_patches(placed, (4, 4), "plane", width, height, ["vec_id"])
    return stamps.last_write(written, ["px", "py"], "value", ["vec_id"]).withColumn("value", F.round("value", 5))


# --- streaming ----------------------------------------------------------------------


def stream_of(t, name):
    return jobs.follow(t.spark, f"{t.dir}/{name}*.parquet", t.raw(name).schema)


@query("stream_reports", "start:s job:l metric:s sum100:l n:l", """
select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, job, metric, sum(value100) as sum100, count(*) as n from metrics
group by time_bucket(interval 1 hour, ts), job, metric""", "metrics")
def _(t):
    """Windows the watermark has closed, and those still open when the stream's data end."""
    def log(events):
        return events.select((F.col("user_id") % 3).cast("int").alias("job"), F.col("event_type").alias("metric"),
                             F.round(F.col("value") * 100).cast("bigint").alias("value100"), F.col("ts").cast("timestamp").alias("ts"))

    closed = jobs.run_to_end(jobs.windowed_reports(log(stream_of(t, "events"))), "reports")
    out = closed.unionByName(jobs.open_reports(closed, log(t.raw("events"))))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_extremes", "volume_id:l step:l low:d p_low:d b_low:d high:d p_high:d b_high:d", f"""
with {SIX_SQL},
p as (select slab * 40 + z as step, slab % 2 as volume_id, low, p1 as p_low, b_low, high, p99 as p_high, b_high from six),
r as (select volume_id, step, min(low) over w as low, min(p_low) over w as p_low, min(b_low) over w as b_low, max(high) over w as high, max(p_high) over w as p_high, max(b_high) over w as b_high
      from p window w as (partition by volume_id order by step rows between unbounded preceding and current row)),
c as (select *, row(low, p_low, b_low, high, p_high, b_high) as now, lag(row(low, p_low, b_low, high, p_high, b_high)) over (partition by volume_id order by step) as before from r)
select volume_id, step, low, p_low, b_low, high, p_high, b_high from c where before is null or now <> before""", "slabs")
def _(t):
    """Slice statistics are written as a table first and then followed as a stream."""
    rows = six_extremes(t).select(
        (F.col("slab") % 2).cast("int").alias("volume_id"), (F.col("slab") * 40 + F.col("z")).cast("bigint").alias("step"),
        *[F.col(c).cast("double").alias(n) for c, n in (("low", "low"), ("p1", "p_low"), ("b_low", "b_low"), ("high", "high"), ("p99", "p_high"), ("b_high", "b_high"))])
    path = scratch_path(t.spark, "slices")
    rows.write.parquet(path)
    return jobs.run_to_end(jobs.running_extremes(jobs.follow(t.spark, path, rows.schema, files_per_trigger=64)), "extremes")


@query("stream_count_windows", "job:l report:l metric:s value:d", f"""
with {LOG} select job, report, metric, round(avg(value100), 6) as value from windowed group by job, report, metric""", "metrics")
def _(t):
    """Reports at every fiftieth batch, whose left-overs go on into the next micro-batch; equal to the windows of the whole log."""
    def log(events):
        return events.select(
            (F.col("user_id") % 3).cast("int").alias("job"), F.col("event_id").cast("bigint").alias("step"), F.col("event_type").alias("metric"),
            F.round(F.col("value") * 100).cast("bigint").alias("value100"), (F.col("event_id") % 1000 % 50 == 0).alias("flush"))

    path = scratch_path(t.spark, "log")
    t.raw("events").repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    rows = log(t.raw("events"))
    # files of one write are as old as each other; one trigger takes them all, several files a trigger are tested by hand
    closed = jobs.run_to_end(jobs.count_windows(log(jobs.follow(t.spark, path, t.raw("events").schema))), "windows")
    every = closed.unionByName(jobs.open_windows(closed, rows))
    return every.select("job", "report", "metric", F.round(F.col("total") / F.col("n"), 6).alias("value"))


@query("stream_upserts", "region:l epoch:l px:l py:l p255:l", """
select region, epoch, px, py, p255 from (select *, row_number() over (partition by region, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as rn from predictions) where rn = 1""", "predictions")
def _(t):
    """Predictions arrive in several micro-batches."""
    spread = scratch_path(t.spark, "incoming")
    t.predictions.repartition(6, "seq").write.parquet(spread)
    stream = jobs.follow(t.spark, spread, t.predictions.schema, files_per_trigger=2)
    path = scratch_path(t.spark, "upserts")
    keys = ["region", "epoch", "px", "py"]
    jobs.upsert_predictions(stream, keys, "p255", WRITE_ORDER, path).awaitTermination()
    return jobs.current(t.spark, path, keys, "p255", WRITE_ORDER)
