"""Toxic spans by a linear-chain conditional random field over words.

Labels are per document, so word labels come first: in toxic learning
documents, words with a feature that toxic documents have far more often than
others. The field is then trained by stochastic gradient in every task, and the
tasks' weights are averaged between rounds. Forward-backward marginals give
each word's probability; a document's sum of -log(1 - p) is calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow import add_columns, fold
from .chain import Sequences, expected, marginals
from .isotonic import Calibrator, calibrate
from .sums import vector_sum
from .words import mix, part_hashes, runs, slices, text_bytes, word_spans

BUCKETS = 1 << 18
PREFIXES = (5, 6, 7, 8)
SUFFIX = 4
CHAIN = 5  # start weight and the four transition weights
RAW_MAX = 20.0
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n|;")] = True


class Tokens:
    """Words of a run of texts: feature buckets, sentences, owners, code point offsets."""

    def __init__(self, texts: pa.Array, owner: np.ndarray):
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
        start, end, first = word_spans(data, offsets)
        parts = [(start, end), *[(start, np.minimum(start + k, end)) for k in PREFIXES], (np.maximum(end - SUFFIX, start), end)]
        hashes = part_hashes(data, start, end, parts)
        self.features = np.stack([(mix(h + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32) for k, h in enumerate(hashes)])
        self.piece = np.repeat(np.arange(len(texts)), np.diff(first))
        self.owner = owner[self.piece]
        breaks = np.r_[0, np.cumsum(_BREAK[data], dtype=np.int32)]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (breaks[start[1:]] != breaks[end[:-1]]) | (self.piece[1:] != self.piece[:-1])
        self.sentences = Sequences(np.r_[np.flatnonzero(fresh), len(start)])
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)]
        lead = points[offsets[:-1]][self.piece]
        self.start, self.end = points[start] - lead, points[end] - lead
        self.lengths = np.diff(points[offsets])

    def psi(self, weights: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(weights[self.features].sum(axis=0), -30, 30))


def _tokens(part: pa.RecordBatch) -> Iterator[Tokens]:
    for texts, owner in runs(part.column("text")):
        yield Tokens(texts, owner)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Documents that have each feature, the others' in front and the toxic ones' behind."""
    total = np.zeros(2 * BUCKETS + 2)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            toxic = part.column("label").to_numpy().astype(int)
            total[2 * BUCKETS:] += np.bincount(toxic, minlength=2)
            keys = [np.unique((t.owner.astype(np.int64) * BUCKETS + t.features).ravel()) for t in _tokens(part)]
            keys = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]
            total[: 2 * BUCKETS] += np.bincount(toxic[keys // BUCKETS] * BUCKETS + keys % BUCKETS, minlength=2 * BUCKETS)
    return total


def find_markers(rows: DataFrame, least: int = 4, deviations: float = 6.0, times: float = 4.0) -> np.ndarray:
    """Features that toxic documents have significantly and ``times`` more often than documents on the whole."""
    total = vector_sum(rows, _document_counts, 2 * BUCKETS + 2)
    clean, toxic, (n_clean, n_toxic) = total[:BUCKETS], total[BUCKETS:2 * BUCKETS], total[2 * BUCKETS:]
    base = n_toxic / max(n_clean + n_toxic, 1)
    n = clean + toxic
    spread = np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
    return (toxic >= least) & (toxic - n * base >= deviations * spread) & (toxic >= min(times * base, 0.5) * n)


class Model:
    def __init__(self, weights: np.ndarray, chain: np.ndarray):
        self.weights, self.chain = weights, chain
        self.calibrator = Calibrator(np.zeros(1), np.zeros(1))

    @staticmethod
    def blank() -> Model:
        return Model(np.zeros(BUCKETS), np.array([-3.0, 0.0, -3.0, 0.0, -1.0]))

    def field(self) -> tuple[float, np.ndarray]:
        return float(np.exp(self.chain[0])), np.exp(self.chain[1:]).reshape(2, 2)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        return marginals(tokens.sentences, tokens.psi(self.weights), *self.field())


def _train(model: Model, markers: np.ndarray, inner: int = 8, rate: float = 0.5, ridge: float = 1e-3):
    """Gradient steps of one task; returns weights times visits, visits, chain weights and 1."""

    def work(batches):
        own = Model(model.weights.copy(), model.chain.copy())
        grown, grown_chain, visits = np.full(BUCKETS, 1e-2), np.full(CHAIN, 1e-2), np.zeros(BUCKETS)
        some = 0.0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                toxic = part.column("label").to_numpy().astype(bool)
                for tokens in _tokens(part):
                    seq, flat = tokens.sentences, tokens.features.ravel()
                    if not seq.size:
                        continue
                    some = 1.0
                    state = toxic[tokens.owner] & markers[tokens.features].any(axis=0)
                    visits += np.bincount(flat, minlength=BUCKETS)
                    pairs = np.bincount(2 * state[seq.later - 1] + state[seq.later], minlength=4)
                    for _ in range(inner):
                        start, t = own.field()
                        p, pair = expected(seq, tokens.psi(own.weights), start, t)
                        miss = state - p
                        slope = np.bincount(flat, np.tile(miss, len(tokens.features)), BUCKETS) - ridge * own.weights
                        grown += slope * slope
                        own.weights += rate * slope / np.sqrt(grown)
                        side = np.r_[miss[seq.begin[seq.length > 0]].sum(), pairs - pair.ravel()]
                        grown_chain += side * side
                        own.chain += rate * side / np.sqrt(grown_chain)
                        own.chain[1:] -= own.chain[1]  # only ratios matter
        return np.r_[own.weights * visits, visits, own.chain * some, some]

    return work


def fit(rows: DataFrame, rounds: int = 2) -> Model:
    """Fit on rows with ``text`` and ``label`` (0 or 1)."""
    markers = find_markers(rows)
    model = Model.blank()
    for _ in range(rounds):
        total = vector_sum(rows, _train(model, markers), 2 * BUCKETS + CHAIN + 1)
        visits, tasks = total[BUCKETS:2 * BUCKETS], total[-1]
        if not tasks:
            break
        model = Model(total[:BUCKETS] / np.maximum(visits, 1), total[2 * BUCKETS:-1] / tasks)
    return model


def _scores(model: Model, threshold: float):
    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        raw = np.zeros(part.num_rows)
        spans: list[list[str]] = [[] for _ in range(part.num_rows)]
        passed = np.zeros(part.num_rows, np.int64)  # code points in earlier pieces of a long text
        for texts, owner in runs(part.column("text")):
            tokens = Tokens(texts, owner)
            p = model.marginals(tokens)
            seen = np.where(p >= 0.02, -np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0)
            np.add.at(raw, tokens.owner, seen)
            begin = np.zeros(len(owner), np.int64)
            for k, o in enumerate(owner):
                begin[k] = passed[o]
                passed[o] += tokens.lengths[k]
            for i in np.flatnonzero(p >= threshold):
                at = begin[tokens.piece[i]]
                spans[tokens.owner[i]].append(f"{at + tokens.start[i]}:{at + tokens.end[i]}")
        return [pa.array(np.minimum(raw, RAW_MAX)), pa.array([",".join(s) for s in spans], pa.string())]

    return compute


def _labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: int, max_broadcast: int) -> DataFrame:
    marks = labels.filter(F.col(label).isNotNull() & (fold(5) != held_out)).select("doc_id", F.col(label).cast("int").alias("label"))
    if marks.count() <= max_broadcast:
        marks = F.broadcast(marks)
    return docs.select("doc_id", "text").join(marks, "doc_id").select("text", "label")


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, threshold: float = 0.5,
          max_broadcast: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    Learns from labels of rows whose crc32(doc_id) mod 5 is not ``held_out``, all
    of them; null labels are skipped. A document's raw score is the sum of -log(1 - p) over
    its words with a marginal p of 0.02 or more: lower ones are the field's noise, which would
    add up with the length of a text. The sum stops at 20, where the chance that no word is
    toxic is below 3e-9; calibration sees it so too. ``spans``: start:end (code points) of words
    with a marginal of ``threshold`` or more. Null and empty texts, and texts without
    words, have no spans and the score of a text without any sign. Without labels every
    score is 0. Labels are broadcast up to ``max_broadcast`` rows (some 75 bytes each, 150 MB), and
    joined by shuffle beyond. Repeated rows agree.
    """
    model = fit(_labelled(docs, labels, label, held_out, max_broadcast))
    rows = docs.select("doc_id", (fold(5) == held_out).alias("held_out"), "text")
    known = materialize(add_columns(rows, lambda: _scores(model, threshold), "raw double, spans string").drop("text"), "toxicity")
    marks = labels.filter(F.col(label).isNotNull() & (fold(5) != held_out)).select("doc_id", F.col(label).alias("label"))
    fitted = calibrate(known.join(marks, "doc_id"), F.col("raw"), F.col("label"), 0.0, RAW_MAX)
    calibrator = fitted if len(fitted.points) else Calibrator(np.zeros(1), np.zeros(1))

    def work(batches):
        for batch in batches:
            value = calibrator(batch.column("raw").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), batch.column("spans")],
                names=["doc_id", "held_out", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
