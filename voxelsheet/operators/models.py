"""Spark ML around samples: fitting, scoring, folds, saved models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import augment, scoring, stamps

CHANNELS = ("r", "g", "b")


def logistic(**params) -> Pipeline:
    return Pipeline(stages=[LogisticRegression(featuresCol="features", labelCol="ink", **params)])


def perceptron(layers: list[int], **params) -> Pipeline:
    return Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol="features", labelCol="ink", layers=layers, **params)])


def channel_regressors(**params) -> Pipeline:
    """One linear model per colour channel."""
    return Pipeline(stages=[LinearRegression(featuresCol="features", labelCol=c, predictionCol=f"{c}_pred", **params) for c in CHANNELS])


def texture_head(scores: str, **params) -> Pipeline:
    """Texture from a column of ink scores alone."""
    return Pipeline(stages=[VectorAssembler(inputCols=[scores], outputCol="_score"),
                            LinearRegression(featuresCol="_score", labelCol="texture", predictionCol="texture_pred", **params)])


def texture_regressor(**params) -> Pipeline:
    """Texture from ink scores: a linear model on the classifier's probability."""
    return Pipeline(stages=[
        LogisticRegression(featuresCol="features", labelCol="ink", probabilityCol="ink_scores", rawPredictionCol="_raw", predictionCol="_class"),
        LinearRegression(featuresCol="ink_scores", labelCol="texture", predictionCol="texture_pred", **params),
    ])


def components(k: int) -> Pipeline:
    return Pipeline(stages=[PCA(k=k, inputCol="features", outputCol="code")])


# Model name -> (pipeline builder, label types it produces).
MODELS: dict[str, tuple[Callable[..., Pipeline], tuple[str, ...]]] = {
    "ink_classifier": (logistic, ("ink_classes",)),
    "ink_perceptron": (perceptron, ("ink_classes",)),
    "rgb_regressor": (channel_regressors, ("rgb_values",)),
    "texture_from_ink": (texture_regressor, ("ink_classes", "volcart_texture")),
    "texture_head": (texture_head, ("volcart_texture",)),
    "autoencoder": (components, ("autoencoded",)),
}


def build(name: str, **params) -> Pipeline:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}")
    return MODELS[name][0](**params)


def with_features(samples: DataFrame, block: str) -> DataFrame:
    return samples.withColumn("features", array_to_vector(F.col(block).cast("array<double>")))


MOST_CELLS = 4096


def fit(name: str, samples: DataFrame, block: str, **params) -> PipelineModel:
    """A fitted pipeline. ``autoencoder`` decomposes a cells x cells matrix on the driver and refuses long blocks: :func:`randomized_basis` is for these."""
    if name == "autoencoder":
        longest = samples.agg(F.max(F.size(block))).first()[0]
        if longest is not None and longest > MOST_CELLS:
            raise ValueError(f"{longest} cells are too many for a whole decomposition (at most {MOST_CELLS}); use randomized_basis")
    return build(name, **params).fit(with_features(samples, block))


def score_ink(model: PipelineModel, samples: DataFrame, block: str) -> DataFrame:
    """Add ``p1``, the probability of ink."""
    rest = samples.columns
    scored = model.transform(with_features(samples, block))
    return scored.select(*rest, vector_to_array("probability")[1].alias("p1"))


Score = Callable[[DataFrame, str], DataFrame]


def ink_scorer(model: PipelineModel) -> Score:
    return lambda samples, block: score_ink(model, samples, block)


def score_averaged(score: Score, samples: DataFrame, block: str, shape, keys: list[str], averaging: bool = True) -> DataFrame:
    """Mean probability over turned and mirrored copies of each sample; ``score`` adds ``p1`` to rows with a block."""
    rows = augment.variant_rows(samples.select(*keys, block), block, shape, averaging)
    return augment.merge_variants(score(rows, block), keys, "p1")


def optimality(scored: DataFrame, block: str, p1: str = "p1", label: str = "ink") -> DataFrame:
    """One row: the largest component of the mean log-likelihood gradient; 0 at the optimum of an unpenalised fit."""
    miss = F.col(p1) - F.col(label)
    per_cell = scored.select(F.posexplode(block).alias("cell", "v"), miss.alias("m")).groupBy("cell").agg(F.abs(F.avg(F.col("v") * F.col("m"))).alias("g"))
    return per_cell.agg(F.max("g").alias("gradient"))


def reconstruct(model: PipelineModel, samples: DataFrame, block: str, keys: list[str]) -> DataFrame:
    """Samples rebuilt from their components, with the squared error of each."""
    basis = model.stages[0].pc.toArray()
    coded = model.transform(with_features(samples, block)).select(*keys, block, vector_to_array("code").alias("code"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = np.asarray(batch.column("code").flatten()).reshape(n, -1)
            real = np.asarray(batch.column(block).flatten(), "f8").reshape(n, -1)
            again = code @ basis.T
            loss = ((again - real) ** 2).mean(1)
            offsets = pa.array(np.arange(n + 1, dtype="i4") * again.shape[1])
            blocks = pa.ListArray.from_arrays(offsets, pa.array(again.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], blocks, pa.array(loss)], [*keys, "rebuilt", "mse"])

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    return coded.mapInArrow(rebuild, f"{kinds}, rebuilt array<double>, mse double")


CELL_ROWS = 256


def _covariance_times(samples: DataFrame, block: str, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of the cells times ``q``, and the mean; tasks add up their rows, groups of cells are summed apart."""
    shared = samples.sparkSession.sparkContext.broadcast(q)
    width = q.shape[1] + 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = shared.value, np.zeros((len(shared.value), width))
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), "f8").reshape(batch.num_rows, -1)
                total += np.column_stack([x.T @ (x @ q), x.sum(0), np.full(x.shape[1], len(x))])
        for at in range(0, len(total), CELL_ROWS):
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total[at:at + CELL_ROWS].tobytes()], pa.binary())], names=["at", "part"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in table.column("part").to_pylist())
        return pa.table({"at": table.column("at")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    rows = samples.select(block).mapInArrow(part, "at int, part binary").groupBy("at").applyInArrow(merge, "at int, part binary").collect()
    whole = np.concatenate([np.frombuffer(r.part).reshape(-1, width) for r in sorted(rows, key=lambda r: r["at"])])
    n = max(whole[0, -1], 1.0)
    mean = whole[:, -2] / n
    return whole[:, :-2] / n - np.outer(mean, mean @ q), mean


def randomized_basis(samples: DataFrame, block: str, k: int, extra: int = 10, passes: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and ``k`` main components (cells x k) by a randomised decomposition.

    Each pass over the samples multiplies their covariance with a few directions;
    the driver holds cells x (k + extra) numbers and never cells x cells.
    """
    first = samples.select(F.size(block)).first()
    if first is None:
        raise ValueError("no samples to learn from")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(first[0], min(first[0], k + extra))))[0]
    for _ in range(passes):
        q = np.linalg.qr(_covariance_times(samples, block, q)[0])[0]
    product, mean = _covariance_times(samples, block, q)
    inner = q.T @ product
    return mean, q @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :k]


def reconstruct_truncated(mean: np.ndarray, basis: np.ndarray, samples: DataFrame, block: str, keys: list[str]) -> DataFrame:
    """Samples rebuilt from a few components around the mean, with the squared error of each."""
    shared = samples.sparkSession.sparkContext.broadcast((mean, basis))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        for batch in batches:
            n = batch.num_rows
            real = np.asarray(batch.column(block).flatten(), "f8").reshape(n, len(mean))
            again = (real - mean) @ basis @ basis.T + mean
            loss = ((again - real) ** 2).mean(1)
            offsets = pa.array(np.arange(n + 1, dtype="i4") * again.shape[1])
            blocks = pa.ListArray.from_arrays(offsets, pa.array(again.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], blocks, pa.array(loss)], [*keys, "rebuilt", "mse"])

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    return samples.select(*keys, block).mapInArrow(rebuild, f"{kinds}, rebuilt array<double>, mse double")


def validate(scored: DataFrame, batch: list[str], p1: str = "p1", label: str = "ink") -> DataFrame:
    """Batch metrics, then their means and sums."""
    pred = F.when(F.col(p1) > 1.0 - F.col(p1), 1).otherwise(0)
    per_batch = scoring.batch_metrics(scored, batch, pred, F.col(label))
    names = [*scoring.BATCH_METRICS, "positive_preds_sum", "negative_preds_sum", "positive_labels_sum", "negative_labels_sum"]
    return scoring.roll_up(per_batch, [], names)


def write_back(scored: DataFrame, spacing: int, width: int, height: int, keys: list[str], order: list[str]) -> DataFrame:
    """Point scores to 16-bit pixels stamped over their grid squares."""
    from ..functions import scalars

    pixels = scored.withColumn("value", scalars.ink_pixel(F.col("p1")))
    return stamps.prediction_image(pixels, spacing, width, height, keys, "value", order)


def fold_scores(name: str, samples: DataFrame, fold: Column, k: int, block: str, keys: list[str], parallelism: int = 4, **params) -> DataFrame:
    """Out-of-fold scores: for every fold one model fitted on the other folds.

    Samples are written once, a folder per fold, so a fit reads its own folds only. Up to
    ``parallelism`` fits run at a time, each in a thread that keeps the session's settings.
    """
    marked = materialize(samples.select(*dict.fromkeys([*keys, "ink", block])).withColumn("fold", fold.cast("int")), "folds", ("fold",))
    one = inheritable_thread_target(marked.sparkSession)(lambda n: fit(name, marked.filter(F.col("fold") != n), block, **params))
    with ThreadPoolExecutor(max_workers=min(k, parallelism)) as pool:
        fitted = list(pool.map(one, range(k)))
    parts = [score_ink(model, marked.filter(F.col("fold") == n), block).select(*keys, "fold", "ink", "p1") for n, model in enumerate(fitted)]
    return reduce(DataFrame.unionByName, parts)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def warm_start(layers: list[int], earlier: PipelineModel, seed: int = 0, **params) -> Pipeline:
    """A perceptron that takes over the earlier weights of every layer whose two sizes match.

    Other layers start from small random weights. A layer's weights lie
    together: inputs x outputs, then one bias per output.
    """
    pipeline = perceptron(layers, **params)
    before, old = list(earlier.stages[0].getLayers()), np.asarray(earlier.stages[0].weights.toArray())
    places = np.cumsum([0] + [(a + 1) * b for a, b in zip(before, before[1:])])
    draw = np.random.default_rng(seed)
    parts = []
    for k, (a, b) in enumerate(zip(layers, layers[1:])):
        same = k + 1 < len(before) and (before[k], before[k + 1]) == (a, b)
        parts.append(old[places[k]:places[k + 1]] if same else draw.normal(scale=1 / np.sqrt(a), size=(a + 1) * b))
    pipeline.getStages()[0].setInitialWeights(Vectors.dense(np.concatenate(parts)))
    return pipeline


def quantile_knots(samples: DataFrame, block: str, knots: int = 17, accuracy: int = 1_000_000) -> list[float]:
    """Intensity quantiles of a sample set; a fixed, short list. Ranks are exact up to ``accuracy`` cells, and within their ``accuracy``-th part beyond."""
    shares = [i / (knots - 1) for i in range(knots)]
    return samples.select(F.explode(block).alias("v")).agg(F.percentile_approx("v", shares, accuracy)).first()[0]


def match_intensity(block: Column, source: list[float], target: list[float]) -> Column:
    """Map intensities of one scan to another's, linear between quantile knots."""

    def mapped(v):
        out = F.lit(float(target[-1]))
        for a, b, c, d in reversed(list(zip(source, source[1:], target, target[1:]))):
            inside = F.lit(float(c)) if b == a else F.lit(float(c)) + (v - float(a)) * ((d - c) / (b - a))
            out = F.when(v <= float(b), inside).otherwise(out)
        return F.when(v <= float(source[0]), float(target[0])).otherwise(out)

    return F.transform(block, lambda v: mapped(v.cast("double")))
