"""Face images as of every iteration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scoring
from .catalog import asof_join
from .regions import merge_on_face

EPOCH_STEP = 10_000_000_000


def iteration_number(epoch: str = "epoch", batch: str = "batch"):
    return F.col(epoch).cast("bigint") * EPOCH_STEP + F.col(batch)


def face_as_of(images: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Merge all regions as of every iteration.

    Which image counts is decided on the list of images (a row per region and
    iteration), ``listed`` where it is at hand, so that pixels are not read for it;
    only then do pixels join it. Columns: epoch, batch, px, py, p255.
    """
    seen = (images if listed is None else listed).select("region", "epoch", "batch", iteration_number().alias("k")).distinct()
    wanted = seen.select("epoch", "batch", "k").distinct()
    regions = seen.agg(F.collect_set("region")).scalar()
    asked = wanted.withColumn("region", F.explode(regions))
    latest = asof_join(
        asked.withColumnsRenamed({"epoch": "as_epoch", "batch": "as_batch"}), seen.select("region", "k", "epoch", "batch"),
        ["region"], "k", ["epoch", "batch"], EPOCH_STEP,
    ).filter(F.col("matched_key").isNotNull())
    # One row per image here, so the first rank of each merge is a short window.
    first = F.min("region").over(Window.partitionBy("as_epoch", "as_batch"))
    chosen = latest.select("region", "epoch", "batch", "as_epoch", "as_batch", first.alias("first_rank"))
    pixels = images.join(chosen, ["region", "epoch", "batch"]).drop("epoch", "batch")
    merged = merge_on_face(pixels, "region", "p255", keys=("as_epoch", "as_batch"))
    return merged.withColumnsRenamed({"as_epoch": "epoch", "as_batch": "batch"})


# --- metrics of every iteration ----------------------------------------------------------

NEVER = (1 << 63) - 1
VALUES = 256


def image_spans(listed: DataFrame) -> DataFrame:
    """region, k, until, first_from, first_until: how long each image counts, and when its region is the first one seen.

    ``listed`` has a row per image (or more: region, epoch, batch). An image counts from its
    iteration until the next one of its region; a region is first from its own first image until a lower one's.
    """
    seen = listed.select("region", iteration_number().alias("k")).distinct()
    until = F.coalesce(F.lead("k").over(Window.partitionBy("region").orderBy("k")), F.lit(NEVER))
    appeared = seen.groupBy("region").agg(F.min("k").alias("first_from"))
    lower = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)  # a row per region
    firsts = appeared.withColumn("first_until", F.coalesce(F.min("first_from").over(lower), F.lit(NEVER)))
    return seen.withColumn("until", until).join(firsts, "region")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of the visible value, counted by iteration, value and label; rows come in order of pixel and start."""
    changes: Counter = Counter()

    def visible(pixel, spans):
        label, weight = pixel[2:]
        bounds = sorted({t for start, stop, *_ in spans for t in (start, stop)})
        active: dict[int, tuple[int, int]] = {}
        at, shown = 0, None
        for now in bounds:
            if now == NEVER:
                break
            active = {region: held for region, held in active.items() if held[0] > now}
            while at < len(spans) and spans[at][0] == now:
                _, stop, region, value = spans[at]
                active[region] = (stop, value)
                at += 1
            top = active[max(active)][1] if active else None
            if top != shown:
                if shown is not None:
                    changes[now, shown, label] -= weight
                if top is not None:
                    changes[now, top, label] += weight
                shown = top

    def out():
        rows = [(*key, n) for key, n in changes.items() if n]
        changes.clear()
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["k", "p255", "label", "n"])

    pixel, spans = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("px", "py", "label", "weight", "start", "stop", "region", "p255")]
        for px, py, label, weight, *span in zip(*columns):
            if (px, py, label, weight) != pixel:
                if spans:
                    visible(pixel, spans)
                pixel, spans = (px, py, label, weight), []
            spans.append(span)
        if len(changes) > 1 << 18:
            yield out()
    if spans:
        visible(pixel, spans)
    yield out()


def metrics_per_iteration(images: DataFrame, listed: DataFrame, raster: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pooled metrics of the merged face as of every iteration: epoch, batch and the columns of :func:`.scoring.pooled`.

    ``images`` are pixels (region, epoch, batch, px, py, p255, box x0..y1). A pixel's visible value
    changes only where an image comes or goes, so an image's pixels are looked at once, whatever the number of iterations:
    changes are counted per iteration, value and label, and a running sum over iterations gives each one's
    histogram of 256 values by two labels. Iterations without any evaluated pixel have no row.
    """
    truth = scoring.evaluation_pixels(raster.select("px", "py").distinct(), raster, boxes, keys=())
    truth = truth.groupBy("px", "py", "label").agg(F.count(F.lit(1)).alias("weight"))
    inside = F.col("x0").isNull() | ((F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1")))
    pixels = images.select("region", iteration_number().alias("k"), "px", "py", "p255", F.coalesce(inside, F.lit(True)).alias("inside"))
    known = pixels.join(image_spans(listed), ["region", "k"]).join(truth, ["px", "py"])
    spans = known.select(
        "px", "py", "label", "weight", F.when(F.col("inside"), F.col("k")).otherwise(F.greatest("k", "first_from")).alias("start"),
        F.when(F.col("inside"), F.col("until")).otherwise(F.least("until", "first_until")).alias("stop"), F.col("region").cast("bigint").alias("region"), "p255")
    order = ["px", "py", "label", "weight", "start"]
    changes = spans.filter("start < stop").repartition("px", "py").sortWithinPartitions(*order).mapInArrow(_sweep, "k bigint, p255 bigint, label bigint, n bigint")
    changes = changes.groupBy("k", "p255", "label").agg(F.sum("n").alias("n"))
    every = listed.select("epoch", "batch", iteration_number().alias("k")).distinct()
    bins = every.withColumn("p255", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(VALUES - 1).cast("bigint"))))
    bins = bins.withColumn("label", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    so_far = Window.partitionBy("p255", "label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    histogram = bins.join(changes, ["k", "p255", "label"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(so_far)).filter("n > 0")
    return scoring.pooled(histogram, ["epoch", "batch"], F.col("p255"), F.col("label"), F.col("n"))
