"""Language identification by rank-order profiles of character n-grams.

Profiles hold the most frequent 1- to 3-grams of each language, counted over
all learnable documents. A document's own most frequent n-grams are compared
with each profile by out-of-place distance: the sum of rank differences, with a
fixed penalty for n-grams the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .arrow import add_columns, fold, group_sums
from .words import mix, runs, slices, text_bytes

PROFILE = 400
HASH_BITS = 40
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_keys(texts: pa.Array) -> np.ndarray:
    """Sorted keys ``text << 40 | hash of n-gram`` of all 1- to 3-grams of all texts.

    Letters are lower-cased; any run of other characters is one space, and
    every text begins and ends with one. N-grams of spaces alone, and those
    that span two words, are left out.
    """
    texts = pc.fill_null(texts, "")
    ended = pc.binary_join_element_wise(pc.utf8_lower(texts), "", "\n")
    data, offsets = text_bytes(ended)
    head = np.cumsum((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    stops = head[offsets[1:] - 1]
    text = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, stops]))
    symbol = np.where(_is_letter()[points], points, 1).astype(np.uint64)
    keep = symbol > 1
    keep[1:] |= symbol[:-1] > 1
    symbol, text = np.r_[np.uint64(1), symbol[keep]], np.r_[0, text[keep]]
    letter = symbol > 1
    one = np.flatnonzero(letter)
    a, b, c = symbol[one - 1], symbol[one], symbol[np.minimum(one + 1, len(symbol) - 1)]
    s = np.uint64(21)
    codes = np.concatenate([b, a << s | b, (b << s | c)[c == 1], (a << s | b) << s | c])
    owner = np.concatenate([text[one], text[one], text[one][c == 1], text[one]]).astype(np.uint64)
    return np.sort(owner << np.uint64(HASH_BITS) | mix(codes) >> np.uint64(64 - HASH_BITS))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[edge], np.diff(np.r_[edge, len(keys)])


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys as of :func:`gram_keys`, in order, and how often each occurs."""
    parts = []
    low = np.uint64((1 << HASH_BITS) - 1)
    for part, owner in runs(pc.fill_null(texts, "")):
        keys, counts = _counted(gram_keys(part))
        parts.append((owner.astype(np.uint64)[(keys >> np.uint64(HASH_BITS)).astype(int)] << np.uint64(HASH_BITS) | keys & low, counts))
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch], flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            keys, counts = gram_counts(part.column("text"))
            names = np.array(part.column("lang").to_pylist(), object)
            owner = (keys >> np.uint64(HASH_BITS)).astype(int)
            grams = keys & np.uint64((1 << HASH_BITS) - 1)
            for name in sorted(set(names)):
                mine = names[owner] == name
                g, n = held.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                g, where = np.unique(np.r_[g, grams[mine]], return_inverse=True)
                held[name] = g, np.bincount(where, np.r_[n, counts[mine]], len(g)).astype(np.int64)
        if sum(len(g) for g, _ in held.values()) > flush:
            yield from _emit(held)
            held = {}
    yield from _emit(held)


def _emit(held) -> Iterator[pa.RecordBatch]:
    for name, (grams, counts) in held.items():
        yield pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)],
                              names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, size: int = PROFILE, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Per language its ``size`` most frequent n-grams (hashes), most frequent first.

    Uses ``text`` and ``lang`` of the rows given. ``size * max_languages``
    numbers at most are broadcast; more languages are an error.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(row.lang, []).append(row.gram)
        if len(profiles) > max_languages:
            raise ValueError(f"more than {max_languages} languages")
    return {name: np.array(grams, np.uint64) for name, grams in profiles.items()}


def _ranked(keys: np.ndarray, counts: np.ndarray, size: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams of each text, their ranks from 0, and where each text's begin."""
    owner = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    order = np.argsort(owner << 32 | (0xFFFFFFFF - counts), kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.searchsorted(owner, np.arange(texts + 1))
    rank = np.arange(len(keys)) - first[:-1][owner]
    near = rank < size
    return keys[near] & np.uint64((1 << HASH_BITS) - 1), rank[near], np.searchsorted(owner[near], np.arange(texts + 1))


class Identifier:
    """Distances of texts to learned profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.num_rows
        grams, rank, first = _ranked(*gram_counts(part.column("text")), self.size, texts)
        n = np.diff(first)
        if not self.names:
            return [pa.array([UNKNOWN] * texts, pa.string()), pa.array(np.zeros(texts))]
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        there = self.grams[at] == grams
        ranks = self.ranks[np.where(there, at, -1)]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - rank[:, None]))
        distance = group_sums(apart, first)
        best = distance.argmin(axis=1)
        score = 1.0 - distance[np.arange(texts), best] / (np.maximum(n, 1) * self.size)
        names = np.array(self.names, object)[best]
        names[n == 0] = UNKNOWN
        return [pa.array(names, pa.string()), pa.array(np.where(n == 0, 0.0, np.clip(score, 0.0, 1.0)))]


def identify(docs: DataFrame, held_out: int = 1, size: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Profiles are learned from rows with a ``lang`` whose crc32(doc_id) mod 3 is not
    ``held_out``. The score is 1 less the out-of-place distance as a share of the
    largest possible one. Null and empty texts, and texts without a letter, are
    ``und`` with score 0; so is every text where there is nothing to learn from.
    Equal distances go to the first language by name. Repeated rows agree.
    """
    model = Identifier(learn_profiles(docs.filter(fold(3) != held_out), size), size)
    rows = docs.select("doc_id", (fold(3) == held_out).alias("held_out"), "text")
    return add_columns(rows, lambda: model, "lang_pred string, score double").drop("text")


def known_language(docs: DataFrame, held_out: int = 1, min_score: float = 0.02, size: int = PROFILE) -> DataFrame:
    """The documents in a known language, all columns as they were.

    Rejected are texts without a letter and those whose n-grams almost all lack in every profile.
    """
    model = Identifier(learn_profiles(docs.filter(fold(3) != held_out), size), size)
    marked = add_columns(docs, lambda: model, "_lang_pred string, _lang_score double")
    return marked.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= min_score)).select(*docs.columns)
