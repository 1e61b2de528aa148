"""Queries that compare predictions with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import regions, scoring, stamps
from ..registry import query

PAIRED = """
paired as (select p.*, case when r.ink > 0 then 1 else 0 end as label, case when p255 / 255e0 > 1e0 - p255 / 255e0 then 1 else 0 end as pred,
                  r.r, r.texture, r.mask
           from predictions p join raster r using (px, py)),
counts as (select job, epoch, batch, count(*) filter (pred = 1 and label = 1) as tp, count(*) filter (pred = 1 and label = 0) as fp,
                  count(*) filter (pred = 0 and label = 0) as tn, count(*) filter (pred = 0 and label = 1) as fn
           from paired group by job, epoch, batch),
rates as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from counts)"""
METRICS = """select job, epoch, batch, tp, fp, tn, fn, tp + fp as pp, tn + fn as np, tp + fn as pl, tn + fp as nl,
       (tp + tn) / nullif(tp + fp + tn + fn, 0) as accuracy, p as precision, r as recall,
       (1 + 0.3e0 * 0.3e0) * (p * r) / (p * 0.3e0 * 0.3e0 + r + 1e-5) as fbeta, (r + tn / nullif(tn + fp, 0)) / 2 as auc from rates"""


def paired(t):
    label = F.when(F.col("ink") > 0, 1).otherwise(0)
    return t.predictions.join(t.raster.drop("face_id"), ["px", "py"]).withColumn("label", label)


def per_batch(t):
    return scoring.batch_metrics(paired(t), ["job", "epoch", "batch"], scoring.predicted_class(F.col("p255")), F.col("label"))


@query("confusion", "job:l epoch:l batch:l tp:l fp:l tn:l fn:l pp:l np:l pl:l nl:l",
       f"with {PAIRED} select * from ({METRICS})", "predictions raster")
def _(t):
    names = {"positive_preds_sum": "pp", "negative_preds_sum": "np", "positive_labels_sum": "pl", "negative_labels_sum": "nl"}
    return per_batch(t).withColumnsRenamed(names)


@query("precision_recall_fbeta", "job:l epoch:l batch:l precision:d recall:d fbeta:d accuracy:d hard_auc:d", f"""
with {PAIRED} select job, epoch, batch, round(precision, 6) as precision, round(recall, 6) as recall, round(fbeta, 6) as fbeta,
     round(accuracy, 6) as accuracy, round(auc, 6) as hard_auc from ({METRICS})""", "predictions raster")
def _(t):
    out = per_batch(t).withColumnRenamed("auc", "hard_auc")
    names = ["precision", "recall", "fbeta", "accuracy", "hard_auc"]
    return out.select("job", "epoch", "batch", *[F.round(n, 6).alias(n) for n in names])


@query("metric_rollup", "job:l precision:d recall:d fbeta:d accuracy:d auc:d positive_preds_sum:l", f"""
with {PAIRED} select job, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(fbeta), 6) as fbeta,
     round(avg(accuracy), 6) as accuracy, round(avg(auc), 6) as auc, sum(pp) as positive_preds_sum from ({METRICS}) group by job""",
       "predictions raster")
def _(t):
    names = ["precision", "recall", "fbeta", "accuracy", "auc"]
    out = scoring.roll_up(per_batch(t), ["job"], [*names, "positive_preds_sum"])
    return out.select("job", *[F.round(n, 6).alias(n) for n in names], "positive_preds_sum")


@query("ranked_auc", "job:l auc:d", f"""
with {PAIRED}, h as (select job, p255, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from paired group by job, p255),
s as (select *, coalesce(sum(neg) over (partition by job order by p255 rows between unbounded preceding and 1 preceding), 0) as below from h)
select job, round(sum(pos * (2 * below + neg)) / 2e0 / (sum(pos) * sum(neg)), 6) as auc from s group by job""", "predictions raster")
def _(t):
    out = scoring.ranked_auc(paired(t), ["job"], "p255", F.col("label"))
    return out.select("job", F.round("auc", 6).alias("auc"))


@query("losses", "epoch:l ink:d rgb:d auto:d texture:d total:d", f"""
with {PAIRED}, l as (select epoch, ln(exp(1e0 - p255 / 255e0) + exp(p255 / 255e0)) - case when label = 1 then p255 / 255e0 else 1e0 - p255 / 255e0 end as ce,
     p255 / 255e0 - r / 255e0 as dr, p10 / 10e0 - texture / 65535e0 as dt from paired),
m as (select epoch, avg(ce) as ink, avg(case when abs(dr) < 1 then dr * dr * 0.5e0 else abs(dr) - 0.5e0 end) as rgb, 2e0 * avg(dr * dr) as auto,
     0.25e0 * avg(case when abs(dt) < 1 then dt * dt * 0.5e0 else abs(dt) - 0.5e0 end) as texture from l group by epoch)
select epoch, round(ink, 6) as ink, round(rgb, 6) as rgb, round(auto, 6) as auto, round(texture, 6) as texture, round(ink + rgb + auto + texture, 6) as total from m""",
       "predictions raster")
def _(t):
    _, yes = scalars.pixel_scores(F.col("p255"))
    red, tex = F.col("r") / 255.0, F.col("texture") / 65535.0
    found = scoring.losses(paired(t), ["epoch"], {
        "ink_classes": (yes, F.col("label")), "rgb_values": (yes, red), "autoencoded": (yes, red), "volcart_texture": (F.col("p10") / 10.0, tex),
    }, {"autoencoded": 2.0, "volcart_texture": 0.25})
    names = {"ink": "ink_classes", "rgb": "rgb_values", "auto": "autoencoded", "texture": "volcart_texture", "total": "total"}
    return found.select("epoch", *[F.round(c, 6).alias(n) for n, c in names.items()])


@query("class_scores", "px:l py:l no_ink:d ink:d", """
select px, py, round(exp(r / 255e0) / (exp(r / 255e0) + exp(g / 255e0)), 6) as no_ink, round(exp(g / 255e0) / (exp(r / 255e0) + exp(g / 255e0)), 6) as ink from raster""",
       "raster")
def _(t):
    a, b = scalars.softmax([F.col("r") / 255.0, F.col("g") / 255.0])
    return t.raster.select("px", "py", F.round(a, 6).alias("no_ink"), F.round(b, 6).alias("ink"))


# --- prediction images ---------------------------------------------------------

IMAGES = """
images as (select region, epoch, batch, px, py, p255 from (
  select *, row_number() over (partition by region, epoch, batch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as rn from predictions) where rn = 1)"""
POOLED = """select {by}, round(ce, 6) as cross_entropy_on_scores, round(p, 6) as precision, round(r, 6) as recall,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as false_positive_rate,
  round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1_aka_dice,
  round(case when 0.25e0 * p + r = 0 then 0 else 1.25e0 * p * r / (0.25e0 * p + r) end, 6) as f05
from (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from (
  select {by}, count(*) filter (pred = 1 and label = 1) as tp, count(*) filter (pred = 1 and label = 0) as fp,
         count(*) filter (pred = 0 and label = 0) as tn, count(*) filter (pred = 0 and label = 1) as fn,
         avg(ln(exp(1e0 - p255 / 255e0) + exp(p255 / 255e0)) - case when label = 1 then p255 / 255e0 else 1e0 - p255 / 255e0 end) as ce
  from evaluated group by {by}))"""
POOLED_COLUMNS = "cross_entropy_on_scores:d precision:d recall:d false_positive_rate:d f1_aka_dice:d f05:d"
CLASSED = "case when r.ink > 0 then 1 else 0 end as label, case when p255 / 255e0 > 1e0 - p255 / 255e0 then 1 else 0 end as pred"

WRITE_ORDER = ["seq", "tie1", "tie2"]


def images(t):
    return stamps.last_write(t.predictions, ["region", "epoch", "batch", "px", "py"], "p255", WRITE_ORDER)


def rounded(df, by):
    names = [c.split(":")[0] for c in POOLED_COLUMNS.split()]
    return df.select(*by, *[F.round(n, 6).alias(n) for n in names])


@query("pooled_scores", f"region:l {POOLED_COLUMNS}", f"""
with {IMAGES}, evaluated as (select i.*, {CLASSED} from images i join raster r using (px, py) where r.mask <> 0)
{POOLED.format(by="region")}""", "predictions raster")
def _(t):
    rows = scoring.evaluation_pixels(images(t), t.raster, keys=())
    return rounded(scoring.pooled(rows, ["region"], F.col("p255"), F.col("label")), ["region"])


@query("boxed_scores", f"path:s {POOLED_COLUMNS}", f"""
with {IMAGES}, evaluated as (select i.*, s.path, {CLASSED} from images i join raster r using (px, py)
  join sources s on s.validation and i.px between s.x0 and s.x1 and i.py between s.y0 and s.y1 where r.mask <> 0)
{POOLED.format(by="path")}""", "predictions raster sources")
def _(t):
    boxes = t.sources.filter("validation").select("path", "x0", "y0", "x1", "y1")
    rows = scoring.evaluation_pixels(images(t), t.raster, boxes, keys=())
    return rounded(scoring.pooled(rows, ["path"], F.col("p255"), F.col("label")), ["path"])


@query("f1_sweep", "threshold:l tp:l fp:l fn:l f1:d", f"""
with {IMAGES}, px as (select i.p255, r.ink from images i join raster r using (px, py) where r.mask <> 0),
c as (select th.i * 10 + 111 as threshold, count(*) filter (p255 >= th.i * 10 + 111 and ink <> 0) as tp,
     count(*) filter (p255 >= th.i * 10 + 111 and ink = 0) as fp, count(*) filter (p255 < th.i * 10 + 111 and ink <> 0) as fn
     from px, range(15) th(i) group by th.i),
r as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from c)
select threshold, tp, fp, fn, round(2 * p * r / nullif(p + r, 0), 6) as f1 from r""", "predictions raster")
def _(t):
    rows = scoring.evaluation_pixels(images(t), t.raster, keys=())
    out = scoring.f1_sweep(rows, "p255", "ink", scoring.SWEEP_THRESHOLDS)
    return out.withColumn("f1", F.round("f1", 6))


STAMPED = """
size as (select * from surface_size),
stamped as (select job, region, epoch, p.px - 1 + dx.i as px, p.py - 1 + dy.i as py, p255, seq, tie1, tie2
            from predictions p, range(2) dx(i), range(2) dy(i)),
written as (select s.*, row_number() over (partition by job, region, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as rn
            from stamped s, size where px >= 0 and py >= 0 and px < size.w and py < size.h)"""


@query("stamp_last_write", "job:l region:l epoch:l px:l py:l p255:l",
       f"with {STAMPED} select * from written where rn = 1", "predictions surface_size")
def _(t):
    width, height = t.surface_size
    return stamps.prediction_image(t.predictions, 2, width, height, ["job", "region", "epoch"], "p255", WRITE_ORDER)


BOXES = "boxes as (select i.i as region, i.i * 10 as x0, 0 as y0, i.i * 10 + 30 as x1, w.h as y1 from range(4) i(i), surface_size w)"


def region_boxes(df, t):
    """Overlapping column boxes, one per prediction region."""
    width, height = t.surface_size
    return df.select("*", (F.col("region") * 10).alias("x0"), F.lit(0).alias("y0"),
                     (F.col("region") * 10 + 30).alias("x1"), F.lit(height).alias("y1"))


@query("face_merge", "epoch:l px:l py:l p255:l", f"""
with {STAMPED}, {BOXES}, img as (select * from (select *, row_number() over (partition by region, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as r2
   from written) where r2 = 1),
kept as (select i.*, b.x0 from img i join boxes b using (region) where region = 0 or (px >= x0 and px < x1 and py >= y0 and py < y1))
select epoch, px, py, p255 from (select *, row_number() over (partition by epoch, px, py order by region desc) as r3 from kept) where r3 = 1""",
       "predictions surface_size")
def _(t):
    width, height = t.surface_size
    img = stamps.prediction_image(t.predictions, 2, width, height, ["region", "epoch"], "p255", WRITE_ORDER)
    return regions.merge_on_face(region_boxes(img, t), "region", "p255", keys=("epoch",))


@query("job_composite", "epoch:l px:l py:l p255:l", f"""
with {STAMPED}, img as (select * from (select *, row_number() over (partition by job, epoch, px, py order by seq desc, tie1 desc, tie2 desc, p255 desc) as r2
   from written) where r2 = 1)
select epoch, px, py, p255 from (select i.*, row_number() over (partition by epoch, px, py order by job desc) as r3
   from img i join raster r using (px, py) where p255 > 0 and mask > 0) where r3 = 1""", "predictions raster surface_size")
def _(t):
    width, height = t.surface_size
    img = stamps.prediction_image(t.predictions, 2, width, height, ["job", "epoch"], "p255", WRITE_ORDER)
    masked = img.join(t.raster.select("px", "py", "mask"), ["px", "py"])
    return regions.composite(masked, "job", "p255", keys=("epoch",))


@query("summary_metrics", f"epoch:l batch:l {POOLED_COLUMNS}", f"""
with {IMAGES}, {BOXES}, its as (select distinct epoch * 10000000000 + batch as k, epoch, batch from images),
seen as (select distinct region, epoch * 10000000000 + batch as k from images),
latest as (select i.epoch, i.batch, s.region, max(s.k) as k from its i join seen s on s.k <= i.k group by all),
pix as (select l.epoch, l.batch, i.region, i.px, i.py, i.p255, min(l.region) over (partition by l.epoch, l.batch) as first
        from latest l join images i on i.region = l.region and i.epoch * 10000000000 + i.batch = l.k),
kept as (select p.* from pix p join boxes b using (region) where p.region = p.first or (px >= x0 and px < x1 and py >= y0 and py < y1)),
merged as (select * from (select *, row_number() over (partition by epoch, batch, px, py order by region desc) as rn from kept) where rn = 1),
evaluated as (select m.epoch, m.batch, m.p255, {CLASSED} from merged m join raster r using (px, py)
  join sources s on s.validation and m.px between s.x0 and s.x1 and m.py between s.y0 and s.y1 where r.mask <> 0)
{POOLED.format(by="epoch, batch")}""", "predictions raster sources surface_size")
def _(t):
    """Pooled metrics per iteration: as-of merge of all regions, masked and boxed, from changes between iterations."""
    from ..operators import summary

    boxes = t.sources.filter("validation").select("x0", "y0", "x1", "y1")
    metrics = summary.metrics_per_iteration(region_boxes(images(t), t), t.predictions, t.raster, boxes)
    return rounded(metrics, ["epoch", "batch"])


@query("face_as_of", "epoch:l batch:l pixels:l total:l", f"""
with {IMAGES}, {BOXES}, its as (select distinct epoch * 10000000000 + batch as k, epoch, batch from images),
seen as (select distinct region, epoch * 10000000000 + batch as k from images),
latest as (select i.epoch, i.batch, s.region, max(s.k) as k from its i join seen s on s.k <= i.k group by all),
pix as (select l.epoch, l.batch, i.region, i.px, i.py, i.p255, min(l.region) over (partition by l.epoch, l.batch) as first
        from latest l join images i on i.region = l.region and i.epoch * 10000000000 + i.batch = l.k),
kept as (select p.* from pix p join boxes b using (region) where p.region = p.first or (px >= x0 and px < x1 and py >= y0 and py < y1)),
merged as (select * from (select *, row_number() over (partition by epoch, batch, px, py order by region desc) as rn from kept) where rn = 1)
select epoch, batch, count(*) as pixels, sum(p255) as total from merged group by epoch, batch""", "predictions surface_size")
def _(t):
    """The merged face itself as of every iteration."""
    from ..operators import summary

    merged = summary.face_as_of(region_boxes(images(t), t), t.predictions)
    return merged.groupBy("epoch", "batch").agg(F.count("*").alias("pixels"), F.sum("p255").alias("total"))
