"""Isotonic calibration of scores from counts in fixed bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to ``values`` (weighted squares), by pooling violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            u, x, m = blocks[-1]
            blocks[-1] = [(v * w + u * x) / (w + x), w + x, m + n]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


class Calibrator:
    """A map from raw scores to the share of positives, non-decreasing, in [0, 1]."""

    def __init__(self, points: np.ndarray, shares: np.ndarray):
        self.points, self.shares = points, shares

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        if len(self.points) == 0:
            return np.full(len(scores), 0.5)
        return np.clip(np.interp(scores, self.points, self.shares), 0.0, 1.0)


def calibrate(rows: DataFrame, score: Column, label: Column, low: float, high: float, bins: int = 2000) -> Calibrator:
    """Fit on all rows; only the counts of at most ``bins`` bins come to the driver."""
    place = F.floor((F.least(F.greatest(score, F.lit(low)), F.lit(high)) - low) / (high - low) * (bins - 1))
    counted = rows.groupBy(place.alias("bin")).agg(F.avg(score).alias("at"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"))
    table = sorted((r.at, r.n, r.ones) for r in counted.filter(F.col("bin").isNotNull()).collect())
    if not table:
        return Calibrator(np.zeros(0), np.zeros(0))
    at, n, ones = (np.array(c, float) for c in zip(*table))
    return Calibrator(at, pool(ones / n, n))
