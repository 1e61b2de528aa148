"""The highest-scoring documents of each search item, by norm buckets in the manner of LEMP.

A document is a vector of integer impacts of the terms that the items have, an
item a vector of integer term weights, and a score is their inner product.
Every task walks through its documents by falling length of their vectors, in
buckets. Cauchy-Schwarz rules out a bucket for all items whose twentieth score
so far is out of reach; inside a bucket the coordinates of an item are taken by
falling weight, and after each few of them the rest of every document is bounded
by the lengths of what is left of both vectors. What survives all coordinates has
its exact integer score. The lists of the tasks, ``top`` rows an item each, then
meet in one window per item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .arrow import add_columns
from .cuts import WORD_END, stretches
from .sums import vector_sum
from .words import slices, text_bytes, word_hashes

TOP = 20
BUCKET_ROWS = 2048
SHRINK = 0.9
STEPS = (2, 4, 8, 16, 32, 64)
LONG = 1 << 20
_NONE = np.iinfo(np.int64).max


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and for each text the index of its first; long texts are cut between terms."""
    _, offsets = text_bytes(texts)
    if len(texts) == 0 or np.diff(offsets).max() <= LONG:
        return word_hashes(texts)
    parts = [list(stretches(t or "", LONG, WORD_END)) for t in texts.to_pylist()]
    found = [word_hashes(pa.array([p], pa.string())) for part in parts for p in part]
    counts = iter([int(first[-1]) for _, first in found])
    whole = [sum(next(counts) for _ in part) for part in parts]
    return np.concatenate([h for h, _ in found]), np.r_[0, np.cumsum(whole)]


def _vectors(vocabulary):
    """For each text: number of terms, places in the vocabulary of the distinct ones that items have, and their counts."""

    def make():
        known = vocabulary.value

        def compute(part):
            hashes, first = term_hashes(part.column("text"))
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            both, tf = np.unique(owner[hit] * len(known) + at[hit], return_counts=True)
            ends = np.searchsorted(both, np.arange(len(first)) * len(known))
            place = (both % len(known)).astype(np.uint32)
            cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            return [pa.array(np.diff(first)), cut(place), cut(tf.astype(np.uint32))]

        return compute

    return make


def _frequencies(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint32), minlength=size)
        return total

    return make


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 75 + (25 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and counts of all rows, and the row of each."""
    places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint32).astype(np.int64)
    tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), np.uint32).astype(np.int64)
    lengths = [len(p.as_buffer()) // 4 for p in batch.column("places")]
    return places, tf, np.repeat(np.arange(batch.num_rows), lengths)


def _norms(documents: int, terms: int):
    def work(batches):
        for batch in batches:
            places, tf, row = _flat(batch)
            p = impacts(tf, batch.column("n").to_numpy()[row], documents, terms)
            squares = np.bincount(row, (p * p).astype(float), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(squares))], names=[*batch.schema.names, "norm"])

    return work


class Item:
    """An item's coordinates by falling weight, and the length of what is left behind each step."""

    def __init__(self, places: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        value = counts * weights[places]
        some = value > 0
        order = np.argsort(-value[some], kind="stable")
        self.places, self.values = places[some][order], value[some][order]
        squares = np.cumsum((self.values.astype(float) ** 2)[::-1])[::-1]
        self.left = np.sqrt(np.r_[squares, 0.0])
        self.score, self.known, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def limit(self, top: int) -> int:
        """What a document must reach to enter the list."""
        return int(self.score[-1]) if len(self.score) == top else 1

    def add(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray, top: int) -> None:
        score, known, doc = np.r_[self.score, score], np.r_[self.known, known], np.r_[self.doc, doc]
        best = np.lexsort((doc, ~known, -score))[:top]
        self.score, self.known, self.doc = score[best], known[best], doc[best]


class Bucket:
    """Documents of about the same length; per term the documents that hold it, with their impacts."""

    def __init__(self, batch: pa.RecordBatch, documents: int, terms: int):
        places, tf, row = _flat(batch)
        p = impacts(tf, batch.column("n").to_numpy()[row], documents, terms)
        order = np.argsort(places, kind="stable")
        self.row, self.p = row[order], p[order]
        self.places, self.first = np.unique(places[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.norm = batch.column("norm").to_numpy()
        ids = batch.column("doc_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc = ids.fill_null(_NONE).to_numpy()

    def search(self, item: Item, top: int) -> None:
        """Enter the documents that reach the item's limit into its list."""
        least = item.limit(top)
        if item.left[0] * self.norm.max() * (1 + 1e-9) < least:
            return
        score, rest = np.zeros(len(self.norm), np.int64), self.norm ** 2
        at = np.searchsorted(self.places, item.places)
        done = 0
        for step in (*STEPS, len(item.places)):
            for k in range(done, min(step, len(item.places))):
                i = at[k]
                if i < len(self.places) and self.places[i] == item.places[k]:
                    holds, p = self.row[self.first[i]:self.first[i + 1]], self.p[self.first[i]:self.first[i + 1]]
                    score[holds] += item.values[k] * p
                    rest[holds] -= p.astype(float) ** 2
            done = max(done, min(step, len(item.places)))
            reach = score + item.left[done] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-3
            if reach.max() < least:
                return
            if done == len(item.places):
                break
        good = np.flatnonzero(score >= least)
        item.add(score[good], self.known[good], self.doc[good], top)


def _buckets(batches: Iterator[pa.RecordBatch], documents: int, terms: int) -> Iterator[Bucket]:
    """Rows arrive by falling norm; a bucket holds ``BUCKET_ROWS`` at most, none shorter than ``SHRINK`` of its longest."""
    for batch in batches:
        for part in slices(batch, "places", 1 << 22):
            norm, start = part.column("norm").to_numpy(), 0
            while start < part.num_rows:
                stop = int(np.searchsorted(-norm, -norm[start] * SHRINK, "right"))
                stop = min(max(stop, start + 256), start + BUCKET_ROWS, part.num_rows)
                yield Bucket(part.slice(start, stop - start), documents, terms)
                start = stop


def _lists(items, weights, documents: int, terms: int, top: int):
    def work(batches):
        mine = [Item(places, counts, weights.value) for places, counts in items.value]
        for bucket in _buckets(batches, documents, terms):
            for item in mine:
                if len(item.places):
                    bucket.search(item, top)
        number = np.repeat(np.arange(len(mine)), [len(item.score) for item in mine])
        if len(number):
            doc, known = np.concatenate([i.doc for i in mine]), np.concatenate([i.known for i in mine])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc, pa.int64(), mask=~known),
                                              pa.array(np.concatenate([i.score for i in mine]), pa.int64())], names=["item", "doc_id", "score"])

    return work


def _rank_block(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    held = items.select(F.col("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toArrow().combine_chunks()
    texts = held.column("text").combine_chunks() if held.num_rows else pa.array([], pa.string())
    hashes, first = term_hashes(texts)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    if not len(vocabulary):
        return _none(docs, items)
    context = spark.sparkContext
    fields = "n bigint, places binary, tf binary"
    vectors = add_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), _vectors(context.broadcast(vocabulary)), fields)
    vectors = materialize(vectors.select("doc_id", "n", "places", "tf").filter("n > 0"), "vectors")
    documents, terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return _none(docs, items)
    df = vector_sum(vectors.select("places"), _frequencies(len(vocabulary)), len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    wanted = [np.unique(place[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
    normed = vectors.mapInArrow(_norms(documents, terms), f"doc_id bigint, {fields}, norm double")
    lists = normed.filter("norm > 0").sortWithinPartitions(F.desc("norm"), "doc_id").mapInArrow(
        _lists(context.broadcast(wanted), context.broadcast(weights), documents, terms, top), "item int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    kind = items.schema["item_id"].dataType
    names = spark.createDataFrame(list(enumerate(held.column("item_id").to_pylist())), f"item int, item_id {kind.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _none(docs: DataFrame, items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = 1 << 24) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0, equal scores by ascending doc_id.

    Terms are maximal runs of ASCII letters and digits (A-Z lowered) and characters
    above U+007F of the whole text; they meet by 64-bit hash. Null and empty texts
    have none: such documents are in no list, such items give no rows. Each row
    of ``items`` has a list of its own, so a repeated item has its list twice; a
    repeated document has a rank for each row, a null doc_id ranks behind its
    equals. Empty tables give no rows. Items come in blocks of about ``item_bytes``
    of text by hash, whose terms and vectors are broadcast; the documents are
    read once for each block.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // item_bytes)
    if blocks <= 1:
        return _rank_block(docs, items, top) if size else _none(docs, items)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_rank_block(docs, items.filter(dealt == k), top) for k in range(blocks)])
