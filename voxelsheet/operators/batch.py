"""Fitted models scored in batches: weights once per worker, blocks in, scores out.

A fitted model becomes plain weight arrays (:class:`Network`), which are stored as a
short table and sent to the workers as a broadcast. ``predict_batch_udf`` hands numpy
batches of blocks to it. Test-time averaging turns and mirrors a batch inside
the worker, so no copies of blocks are shuffled or sent.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import models, stamps
from .augment import VARIANTS

MOST_BYTES = 1 << 30


@dataclass(frozen=True)
class Network:
    """Dense layers with sigmoid between them; ``channels`` outputs per pixel of a plane of ``plane`` pixels, channel first."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    softmax: bool
    channels: int
    plane: tuple[int, int] = (1, 1)

    def __call__(self, blocks: np.ndarray) -> np.ndarray:
        """Scores (rows, channels, height, width) of flat blocks."""
        value = np.asarray(blocks, np.float64).reshape(len(blocks), -1)
        for k, (weights, bias) in enumerate(self.layers):
            value = value @ weights + bias
            if k < len(self.layers) - 1:
                value = 1.0 / (1.0 + np.exp(-value))
        value = value.reshape(len(blocks), self.channels, *self.plane)
        if self.softmax:
            value = np.exp(value - value.max(axis=1, keepdims=True))
            value /= value.sum(axis=1, keepdims=True)
        return value

    @property
    def size(self) -> int:
        return sum(w.nbytes + b.nbytes for w, b in self.layers)


def network(model: PipelineModel) -> Network:
    """The weights of a fitted pipeline: logistic, perceptron, or linear regressors (one channel each)."""
    stages = model.stages
    if all(isinstance(s, LinearRegressionModel) for s in stages):
        weights = np.column_stack([s.coefficients.toArray() for s in stages])
        return Network(((weights, np.array([s.intercept for s in stages])),), False, len(stages))
    if isinstance(stages[0], LogisticRegressionModel) and len(stages) == 1:
        one = stages[0].coefficients.toArray()
        return Network(((np.column_stack([np.zeros_like(one), one]), np.array([0.0, stages[0].intercept])),), True, 2)
    if isinstance(stages[0], MultilayerPerceptronClassificationModel) and len(stages) == 1:
        sizes, flat, at, layers = list(stages[0].getLayers()), stages[0].weights.toArray(), 0, []
        for a, b in zip(sizes, sizes[1:]):
            layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b
        return Network(tuple(layers), True, sizes[-1])
    raise ValueError(f"no weights known of {[type(s).__name__ for s in stages]}")


def centroid_network(samples: DataFrame, block: str, label: str = "ink") -> Network:
    """A classifier in closed form: which of the two class means is nearer.

    One aggregation, combined ahead of the shuffle; cells x 2 numbers reach the driver.
    """
    cells = samples.select(F.col(label).alias("label"), F.posexplode(block).alias("cell", "v"))
    means = cells.groupBy("cell").agg(*[F.avg(F.when(F.col("label") == k, F.col("v").cast("double"))).alias(f"m{k}") for k in (0, 1)]).orderBy("cell").toArrow()
    m0, m1 = (means.column(c).to_numpy() for c in ("m0", "m1"))
    if not len(m0) or np.isnan(m0).any() or np.isnan(m1).any():
        raise ValueError("samples of both classes are needed")
    weights = np.column_stack([np.zeros_like(m0), m1 - m0])
    return Network(((weights, np.array([0.0, (m0 @ m0 - m1 @ m1) / 2])),), True, 2)


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    """A row per array, on any file system that Spark writes."""
    rows = [(k, kind, list(a.shape), a.astype("<f8").tobytes()) for k, pair in enumerate(net.layers) for kind, a in zip("wb", pair)]
    rows.append((-1, json.dumps({"softmax": net.softmax, "channels": net.channels, "plane": list(net.plane)}), [], b""))
    spark.createDataFrame(rows, "layer int, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    rows = spark.read.parquet(path).collect()
    about = json.loads(next(r.kind for r in rows if r.layer < 0))
    arrays = {(r.layer, r.kind): np.frombuffer(r.data, "<f8").reshape(r["shape"]) for r in rows if r.layer >= 0}
    layers = tuple((arrays[k, "w"], arrays[k, "b"]) for k in range(len(arrays) // 2))
    return Network(layers, about["softmax"], about["channels"], tuple(about["plane"]))


def averaged(net: Callable[[np.ndarray], np.ndarray], blocks: np.ndarray, shape, averaging: bool) -> np.ndarray:
    """Mean scores over turned and mirrored copies (y, x plane) of a batch, each turned back."""
    cubes = blocks.reshape(len(blocks), *shape)
    total = 0.0
    variants = VARIANTS if averaging else VARIANTS[:1]
    for turns, mirror in variants:
        turned = np.rot90(cubes, turns, (2, 3))
        scores = net(np.ascontiguousarray(turned[..., ::-1] if mirror else turned))
        total = total + np.rot90(scores[..., ::-1] if mirror else scores, -turns, (2, 3))
    return total / len(variants)


def predict(samples: DataFrame, block: str, net: Network, shape, averaging: bool = False, before: Callable[[np.ndarray], np.ndarray] | None = None,
            rows: int = 256) -> DataFrame:
    """``samples`` with ``scores``: channel-first flat scores of each sample's block.

    ``before`` maps a batch of flat blocks ahead of the model. A worker gets the weights once, and ``rows`` blocks at a time.
    """
    if net.size > MOST_BYTES:
        raise ValueError(f"{net.size} bytes of weights are more than a broadcast should hold")
    shared = samples.sparkSession.sparkContext.broadcast(net)
    cells = int(np.prod(shape))

    def make():
        held = shared.value

        def score(blocks: np.ndarray) -> np.ndarray:
            ready = blocks if before is None else before(blocks)
            return averaged(held, ready, shape, averaging).reshape(len(blocks), -1)

        return score

    udf = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=rows, input_tensor_shapes=[[cells]])
    return samples.withColumn("scores", udf(F.col(block).cast("array<double>")))


def ink_scores(scored: DataFrame) -> DataFrame:
    """``p1``, the ink channel of a model with one pixel a sample, in place of ``scores``."""
    return scored.withColumn("p1", F.get("scores", 1)).drop("scores")


def channel_planes(scored: DataFrame, net: Network, channel: int) -> DataFrame:
    """``plane``: one channel of the scores of each sample."""
    pixels = net.plane[0] * net.plane[1]
    return scored.withColumn("plane", F.slice("scores", channel * pixels + 1, pixels)).drop("scores")


def prediction_image(samples: DataFrame, block: str, net: Network, shape, spacing: int, size: tuple[int, int], keys: list[str], order: list[str],
                     averaging: bool = True) -> DataFrame:
    """keys, px, py, value: scores of samples at surface pixels, averaged over turned copies and written back.

    One-pixel models fill the grid square of a point, others write their ink plane around it; later writes win.
    """
    scored = predict(samples, block, net, shape, averaging)
    width, height = size
    if net.plane == (1, 1):
        return models.write_back(ink_scores(scored), spacing, width, height, keys, order)
    placed = channel_planes(scored, net, 1)
    written = stamps.stamp_patches(placed, net.plane, "plane", width, height, [*keys, *order])
    image = stamps.last_write(written, [*keys, "px", "py"], "value", order)
    return image.withColumn("value", (F.col("value") * 65535).cast("int"))


def validation(samples: DataFrame, block: str, net: Network, shape, batch: list[str], before=None) -> DataFrame:
    """Metrics per batch of a fitted model on labelled samples, then their means and sums."""
    return models.validate(ink_scores(predict(samples, block, net, shape, before=before)), batch)


# --- sample transform ahead of a model -------------------------------------------------


class _Matching(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    domainCol = Param(Params._dummy(), "domainCol", "true for rows of the scan to be mapped, false for those of the scan to map to", TypeConverters.toString)
    knots = Param(Params._dummy(), "knots", "number of quantiles", TypeConverters.toInt)
    accuracy = Param(Params._dummy(), "accuracy", "accuracy of the quantiles", TypeConverters.toInt)


class IntensityMatch(Estimator, _Matching):
    """Learns quantile knots of two scans, for use as a stage of any pipeline."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, domainCol=None, knots=17, accuracy=1_000_000):
        super().__init__()
        self._setDefault(knots=17, accuracy=1_000_000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> IntensityMatchModel:
        column, domain = self.getInputCol(), F.col(self.getOrDefault(self.domainCol))
        count, accuracy = self.getOrDefault(self.knots), self.getOrDefault(self.accuracy)
        source, target = (models.quantile_knots(dataset.filter(c), column, count, accuracy) for c in (domain, ~domain))
        if source is None or target is None:
            raise ValueError("rows of both scans are needed")
        fitted = IntensityMatchModel(source=[float(v) for v in source], target=[float(v) for v in target])
        return self._copyValues(fitted)


class IntensityMatchModel(Model, _Matching):
    """Maps intensities of one scan to another's, linear between knots; rows of the other scan stay as they are."""

    source = Param(Params._dummy(), "source", "knots of the scan to be mapped", TypeConverters.toListFloat)
    target = Param(Params._dummy(), "target", "knots of the scan to map to", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, source=None, target=None):
        super().__init__()
        self._setDefault(knots=17, accuracy=1_000_000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        block: Column = F.col(self.getInputCol())
        mapped = models.match_intensity(block, self.getOrDefault(self.source), self.getOrDefault(self.target))
        plain = F.transform(block, lambda v: v.cast("double"))
        return dataset.withColumn(self.getOutputCol(), F.when(F.col(self.getOrDefault(self.domainCol)), mapped).otherwise(plain))
