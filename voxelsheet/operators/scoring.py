"""Comparing predictions with labels.

Counts come first and ratios last: one conditional-sum aggregate per group,
which combines before the shuffle, then arithmetic on the few result rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars

CONFUSION = ("tp", "fp", "tn", "fn")


def predicted_class(p255: Column) -> Column:
    """Argmax over (1-p, p); a tie is class 0."""
    no, yes = scalars.pixel_scores(p255)
    return F.when(yes > no, 1).otherwise(0)


def confusion_counts(pred: Column, label: Column) -> list[Column]:
    one, zero = F.lit(1), F.lit(0)
    pairs = {"tp": (one, one), "fp": (one, zero), "tn": (zero, zero), "fn": (zero, one)}
    return [F.count_if((pred == p) & (label == y)).alias(n) for n, (p, y) in pairs.items()]


def _c():
    return [F.col(n) for n in CONFUSION]


def recall() -> Column:
    tp, fp, tn, fn = _c()
    return F.try_divide(tp, tp + fn)


def precision() -> Column:
    tp, fp, tn, fn = _c()
    return F.try_divide(tp, tp + fp)


def fbeta(beta: float = 0.3) -> Column:
    p, r = precision(), recall()
    return (1 + beta**2) * (p * r) / (p * beta**2 + r + 1e-5)


def accuracy() -> Column:
    tp, fp, tn, fn = _c()
    return F.try_divide(tp + tn, tp + fp + tn + fn)


def hard_auc() -> Column:
    """ROC AUC of 0/1 predictions: mean of both class recalls; null with one class."""
    tp, fp, tn, fn = _c()
    return (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2


def predicted_and_labelled() -> list[Column]:
    tp, fp, tn, fn = _c()
    return [
        (tp + fp).alias("positive_preds_sum"), (tn + fn).alias("negative_preds_sum"),
        (tp + fn).alias("positive_labels_sum"), (tn + fp).alias("negative_labels_sum"),
    ]


def cross_entropy(no: Column, yes: Column, label: Column) -> Column:
    """Row loss with the two scores taken as logits."""
    picked = F.when(label == 1, yes).otherwise(no)
    top = F.greatest(no, yes)
    return F.log(F.exp(no - top) + F.exp(yes - top)) + top - picked


def smooth_l1(pred: Column, label: Column) -> Column:
    d = F.abs(pred - label)
    return F.when(d < 1, d * d * 0.5).otherwise(d - 0.5)


def squared_error(pred: Column, label: Column) -> Column:
    return (pred - label) * (pred - label)


def ink_loss(p1: Column, label: Column) -> Column:
    return cross_entropy(1.0 - p1, p1, label)


# Row losses by label type; each takes (prediction, label). The mean is taken
# times the factor beside it, which a run may replace.
LOSSES: dict[str, tuple[Callable[[Column, Column], Column], float]] = {
    "ink_classes": (ink_loss, 1.0),
    "rgb_values": (smooth_l1, 1.0),
    "autoencoded": (squared_error, 1.0),
    "volcart_texture": (smooth_l1, 1.0),
}


def losses(rows: DataFrame, by: list[str], outputs: dict[str, tuple[Column, Column]], weights: dict[str, float] | None = None) -> DataFrame:
    """Mean loss of each label type that has outputs (prediction, label), and their ``total``."""
    parts = []
    for name, (pred, label) in outputs.items():
        row_loss, weight = LOSSES[name]
        parts.append((F.avg(row_loss(pred, label)) * (weights or {}).get(name, weight)).alias(name))
    means = rows.groupBy(*by).agg(*parts)
    return means.withColumn("total", sum((F.col(n) for n in list(outputs)[1:]), F.col(next(iter(outputs)))))

BATCH_METRICS: dict[str, Callable[[], Column]] = {
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "fbeta": fbeta,
    "auc": hard_auc,
}


def batch_metrics(rows: DataFrame, by: list[str], pred: Column, label: Column) -> DataFrame:
    """Confusion counts, sums and ratios per batch; ratios are null on empty denominators."""
    counts = rows.groupBy(*by).agg(*confusion_counts(pred, label))
    return counts.select(
        *by, *CONFUSION, *predicted_and_labelled(), *[f().alias(n) for n, f in BATCH_METRICS.items()]
    )


def roll_up(wide: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean of batch values per metric, or their sum where the name says so; nulls and NaN skipped."""
    clean = {n: F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")) for n in names}
    return wide.groupBy(*by).agg(*[(F.sum(c) if "sum" in n else F.avg(c)).alias(n) for n, c in clean.items()])


def ranked_auc(rows: DataFrame, by: list[str], score: str, label: Column) -> DataFrame:
    """ROC AUC over whole-number scores, ties counted half.

    Rows shrink to one per score first; the window then sees at most as many
    rows as there are score values.
    """
    per_score = rows.groupBy(*by, score).agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    steps = per_score.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("below") * 2 + F.col("neg")))
    return steps.groupBy(*by).agg(F.try_divide(won / 2.0, F.sum("pos") * F.sum("neg")).alias("auc"))


def pooled(rows: DataFrame, by: list[str], p255: Column, label: Column, n: Column | None = None) -> DataFrame:
    """Pooled evaluation: ratio of sums, 0 on empty denominators.

    ``cross_entropy_on_scores`` takes the probabilities as logits. ``n`` says how many
    pixels a row stands for.
    """
    no, yes = scalars.pixel_scores(p255)
    pred, loss = predicted_class(p255), cross_entropy(no, yes, label)
    if n is None:
        parts = [*confusion_counts(pred, label), F.avg(loss).alias("cross_entropy_on_scores")]
    else:
        pairs = {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}
        parts = [F.sum(F.when((pred == p) & (label == y), n).otherwise(0)).alias(name) for name, (p, y) in pairs.items()]
        parts.append((F.sum(loss * n) / F.sum(n)).alias("cross_entropy_on_scores"))
    counts = rows.groupBy(*by).agg(*parts)
    tp, fp, tn, fn = _c()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratios = counts.select(
        *by, "cross_entropy_on_scores", zero(precision()).alias("precision"), zero(recall()).alias("recall"),
        zero(F.try_divide(fp, fp + tn)).alias("false_positive_rate"),
    )
    p, r = F.col("precision"), F.col("recall")
    return ratios.select("*", scalars.f_score(p, r).alias("f1_aka_dice"), scalars.f_score(p, r, 0.5).alias("f05"))


def evaluation_pixels(predictions: DataFrame, raster: DataFrame, boxes: DataFrame | None = None, keys=("face_id",)) -> DataFrame:
    """Masked pixels of prediction and label; boxes are closed at both ends."""
    from .regions import in_boxes

    keys = list(keys)
    joined = predictions.join(raster.filter("mask != 0").select(*keys, "px", "py", "ink"), [*keys, "px", "py"])
    rows = joined.withColumn("label", F.when(F.col("ink") > 0, 1).otherwise(0))
    return rows if boxes is None else in_boxes(rows, boxes, closed=True)


def f1_sweep(rows: DataFrame, p255: str, label: str, thresholds: list[int]) -> DataFrame:
    """F1 per threshold. Pixels shrink to a histogram of 256 values times two
    labels before the thresholds multiply them."""
    histogram = rows.groupBy(p255, label).agg(F.count("*").alias("n"))
    swept = histogram.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    on, truth, n = F.col(p255) >= F.col("threshold"), F.col(label) != 0, F.col("n")
    count = lambda c: F.sum(F.when(c, n).otherwise(0))
    counts = swept.groupBy("threshold").agg(
        count(on & truth).alias("tp"), count(on & ~truth).alias("fp"), count(~on & truth).alias("fn"),
        count(~on & ~truth).alias("tn"),
    )
    p, r = precision(), recall()
    return counts.select("threshold", "tp", "fp", "fn", F.try_divide(2 * p * r, p + r).alias("f1"))


SWEEP_THRESHOLDS = list(range(111, 255, 10))
