"""Quality scores: random Fourier features of document statistics.

Statistics of whole texts are computed once and kept as a narrow table. Random
Fourier features approximate a Gaussian kernel over them; tasks add up the
normal equations of ridge regression, the driver solves one system of fixed
size, and isotonic regression turns raw scores into probabilities. All labelled
rows of the learning folds take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow import add_columns, fold, group_sums
from .isotonic import Calibrator, calibrate
from .sums import vector_sum
from .words import runs, shingles, span_hashes, text_bytes, word_spans

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "space", "newline", "stops", "symbols", "other", "exclaim", "bar",
    "word_length", "word_spread", "log_words", "distinct_words", "repeated_runs", "repeated_lines", "line_length",
)
FEATURES = 256
_CLASSES = 9


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)  # symbols
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:'\"-?()")):
        table[list(chars.encode())] = k
    table[128:] = 7
    table[ord("|")] = 8
    return table


_CLASS = _class_table()


def _distinct(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of values and of different values."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o, minlength=texts), np.bincount(o[fresh], minlength=texts)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; all zero for an empty or null one."""
    n = len(texts)
    sums = np.zeros((n, _CLASSES + 4))
    words, lines, repeats = [], [], []
    for part, owner in runs(texts):
        data, offsets = text_bytes(part)
        kind = _CLASS[data]
        for k in range(_CLASSES):
            np.add.at(sums[:, k], owner, group_sums(kind == k, offsets))
        np.add.at(sums[:, _CLASSES], owner, group_sums(data == ord("!"), offsets))
        start, end, first = word_spans(data, offsets)
        size = (end - start).astype(float)
        np.add.at(sums[:, _CLASSES + 1], owner, group_sums(size, first))
        np.add.at(sums[:, _CLASSES + 2], owner, group_sums(size * size, first))
        hashes = span_hashes(data, start, end)
        words.append((hashes, np.repeat(owner, np.diff(first))))
        run, text = shingles(hashes, first, 3)
        repeats.append((run, owner[text]))
        breaks = data == 10
        edge = np.unique(np.r_[offsets, np.flatnonzero(breaks) + 1])
        filled = (edge[1:] - edge[:-1]) > 1
        lines.append((span_hashes(data, edge[:-1][filled], edge[1:][filled] - breaks[edge[1:][filled] - 1]),
                      owner[np.searchsorted(offsets, edge[:-1][filled], "right") - 1]))
    many, different = _distinct(*map(np.concatenate, zip(*words)), n)
    run_count, run_kinds = _distinct(*map(np.concatenate, zip(*repeats)), n)
    line_count, line_kinds = _distinct(*map(np.concatenate, zip(*lines)), n)
    size = sums[:, :_CLASSES].sum(axis=1)
    whole, letters = np.maximum(size, 1), np.maximum(sums[:, 0] + sums[:, 1] + sums[:, 7], 1)
    mean = sums[:, _CLASSES + 1] / np.maximum(many, 1)
    spread = np.sqrt(np.maximum(sums[:, _CLASSES + 2] / np.maximum(many, 1) - mean * mean, 0))
    return np.column_stack([
        np.log1p(size), letters / whole * (size > 0), sums[:, 1] / letters, sums[:, 2] / whole, sums[:, 3] / whole, sums[:, 4] / whole,
        sums[:, 5] / whole, sums[:, 6] / whole, sums[:, 7] / whole, sums[:, _CLASSES] / whole, sums[:, 8] / whole,
        mean, spread, np.log1p(many), different / np.maximum(many, 1), 1 - (run_kinds + (run_count == 0)) / np.maximum(run_count, 1),
        1 - (line_kinds + (line_count == 0)) / np.maximum(line_count, 1), np.log1p(size / np.maximum(line_count, 1)),
    ])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), len(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``stats``: ``STATISTICS`` as packed doubles."""

    def make():
        def compute(part):
            return [pa.array([row.tobytes() for row in statistics(part.column("text"))], pa.binary())]
        return compute

    return add_columns(docs, make, "stats binary")


class Model:
    """Standardization, random features, ridge weights, calibration."""

    def __init__(self, mean, scale, seed: int = 7, features: int = FEATURES):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.width = np.sqrt(len(mean) / 2)
        self.turn = draw.normal(size=(len(mean), features)) / self.width
        self.shift = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.calibrator = Calibrator(np.zeros(0), np.zeros(0))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.column_stack([wave, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def fit(rows: DataFrame, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Fit on rows with ``stats`` and ``label`` (0 or 1). Without rows every score is 0.5."""
    k = len(STATISTICS)
    rows = rows.select("stats", F.col("label").cast("double").alias("label"))

    def moments(batches):
        total = np.zeros(2 * k + 1)
        for batch in batches:
            x = _matrix(batch.column("stats"))
            total += np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]
        return total

    total = vector_sum(rows, moments, 2 * k + 1)
    n = max(total[0], 1.0)
    mean = total[1:k + 1] / n
    scale = np.sqrt(np.maximum(total[k + 1:] / n - mean * mean, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), seed)
    if not total[0]:
        return model
    width = len(model.weights)

    def equations(batches):
        left, right = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = model.features(_matrix(batch.column("stats")))
            left += z.T @ z
            right += z.T @ batch.column("label").to_numpy()
        return np.r_[left.ravel(), right]

    sums = vector_sum(rows, equations, width * width + width)
    left = sums[: width * width].reshape(width, width)
    model.weights = np.linalg.solve(left + ridge * n * np.eye(width), sums[width * width:])
    scored = rows.mapInArrow(_raw_scores(model), "raw double, label double")
    model.calibrator = calibrate(scored, F.col("raw"), F.col("label"), -0.5, 1.5)
    return model


def _raw_scores(model: Model):
    def work(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(model.raw(_matrix(batch.column("stats")))), batch.column("label")], names=["raw", "label"])

    return work


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labels of rows whose crc32(doc_id) mod 3 is not ``held_out``, all of
    them; null labels are skipped. Null texts score like empty ones. Repeated
    document rows each get their score; a repeated label counts each time.
    """
    rows = docs.select("doc_id", (fold(3) == held_out).alias("held_out"), "text")
    known = materialize(with_statistics(rows).drop("text"), "statistics")
    marks = labels.filter(F.col(label).isNotNull() & (fold(3) != held_out)).select("doc_id", F.col(label).alias("label"))
    # joined once: three passes read it
    model = fit(materialize(known.join(marks, "doc_id").select("stats", "label"), "labelled"))

    def work(batches):
        for batch in batches:
            value = model.calibrator(model.raw(_matrix(batch.column("stats"))))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
