"""Benchmark decontamination on built-in functions only.

The benchmark's word windows become broadcast hash sets (behind a count; larger
ones are joined by shuffle). Any run of ``len`` words holds a whole block of
``(len + 1) // 2`` words that starts at a multiple of the block length, so only
those blocks of a document are hashed and looked up among the blocks of the
windows; around a found block the windows themselves are compared word by
word. Documents are not shuffled: only hits and one narrow row per document are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .arrow import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
WINDOW = 13
MOST_BYTES = 64 << 20


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _words(text: Column) -> Column:
    """Words with A-Z lowered; other letters keep their case."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    spaced = F.trim(F.regexp_replace(lowered, GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _block(length: int) -> int:
    return (length + 1) // 2


def _get(at: Column, count: int, words: str = "words") -> list[Column]:
    """``count`` words from place ``at`` (from 0)."""
    return [F.get(words, at + k) for k in range(count)]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, len, win: every run of ``window`` words, or a shorter item's only one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _words(_text()).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    start = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("start")
    return items.select("item_id", "len", "words", start).select(
        "item_id", "len", F.array_join(F.slice("words", F.col("start"), F.col("len")), " ").alias("win")).distinct()


def _starts(last: Column, step: int) -> Column:
    """0, ``step``, ... up to ``last``; none if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _hashed(length: int, step: int) -> Column:
    block = _block(length)
    return F.transform(_starts(F.size("words") - block, step), lambda i: F.struct(
        i.alias("at"), F.lit(length).alias("len"), F.xxhash64(*_get(i, block)).alias("h")))


def _all(lengths: list[int], make, kind: str) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [make(n) for n in lengths]) if lengths else F.array().cast(kind)


def hits(docs: DataFrame, windows: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """doc_id, text_key, pos, len, win: occurrences of the windows, by first word (from 0)."""
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # at most WINDOW values
    wanted = windows.select("len", "win").distinct()
    kind = "array<struct<at:int,len:int,h:bigint>>"
    blocks = wanted.withColumn("words", F.split("win", " ")).select(F.col("len").alias("own"), F.inline(_all(lengths, lambda n: _hashed(n, 1), kind)))
    blocks = materialize(blocks.filter("own = len").select("len", "h").distinct(), "blocks")
    small = blocks.count() <= max_broadcast
    if small:
        blocks = F.broadcast(blocks)
    if small and (wanted.agg(F.sum(F.octet_length("win"))).first()[0] or 0) <= MOST_BYTES:  # a word has no greatest length
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _words(_text()).alias("words"))
    keyed = texts.select("doc_id", "text_key", "words", F.inline(_all(lengths, lambda n: _hashed(n, _block(n)), kind)))
    # the words that windows around a block can hold: two windows' worth, however long the document is
    low = F.greatest(F.lit(0), F.col("at") + F.floor((F.col("len") + 1) / 2).cast("int") - F.col("len"))
    around = ["doc_id", "text_key", "len", "h", "at", low.alias("low"), F.slice("words", low + 1, F.col("len") * 2).alias("near")]
    found = keyed.join(blocks, ["h", "len"]).select(*around) if small else keyed.select(*around).join(blocks, ["h", "len"])
    last = F.least(F.col("at") - F.col("low"), F.size("near") - F.col("len"))
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    spots = found.select("doc_id", "text_key", "low", "near", "len", F.explode(places).alias("place"))
    win = reduce(lambda rest, n: F.when(F.col("len") == n, F.concat_ws(" ", *_get(F.col("place"), n, "near"))).otherwise(rest), lengths, F.lit(None).cast("string"))
    named = spots.select("doc_id", "text_key", (F.col("low") + F.col("place")).alias("pos"), "len", win.alias("win"))
    return named.join(wanted, ["win", "len"]).select("doc_id", "text_key", "pos", "len", "win")


def _covered(runs: Column) -> Column:
    """Words inside the runs (structs of pos and len), each counted once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(state, run):
        stop = run["pos"] + run["len"]
        fresh = stop - F.greatest(run["pos"], state["end"])
        return F.struct(F.greatest(state["end"], stop).alias("end"),
                        (state["n"] + F.greatest(fresh, F.lit(0))).cast("bigint").alias("n"))

    return F.aggregate(F.array_sort(runs), start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 200_000, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least one word in ``share`` lies inside a
    benchmark window. Null and empty texts, and texts without words, have no
    hits; an empty benchmark or one without words marks nothing. Repeated rows
    each get the row of their text.
    """
    windows = materialize(benchmark_windows(benchmark), "windows")
    found = materialize(hits(docs, windows, max_broadcast), "hits")
    keys = ["doc_id", "text_key"]
    runs = found.groupBy(*keys).agg(F.collect_set(F.struct("pos", "len")).alias("runs")).select(*keys, _covered(F.col("runs")).alias("n_hit"))
    names = found.select(*keys, "win").distinct().join(windows.select("win", "item_id"), "win").groupBy(*keys).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(_text(), F.lit(WORD)).cast("bigint").alias("n_words"))

    def attach(left, right):
        right = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
        return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["text_key"] == right["_key"]), "left").drop("_id", "_key")

    joined = attach(attach(base, runs), names)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 200_000, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, all columns as they were.

    Null and empty texts stay, and everything where the benchmark has no words; rows equal in id and text stay or go together.
    """
    windows = materialize(benchmark_windows(benchmark), "windows")
    found = hits(docs, windows, max_broadcast)
    runs = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "len")).alias("runs"))
    runs = materialize(runs.select("doc_id", "text_key", _covered(F.col("runs")).alias("n_hit")), "hits")
    own = runs.count()
    of_id, of_text, of_hits = (unused(docs, name) for name in ("_id", "_key", "_hit"))
    runs = runs.select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_text), F.col("n_hit").alias(of_hits))
    bad = (F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_text))
           & (F.col(of_hits) * share >= F.regexp_count(_text(), F.lit(WORD))))
    return docs.join(F.broadcast(runs) if own <= max_broadcast else runs, bad, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """All documents, with the words inside benchmark windows cut out of ``text``.

    Each word goes with what follows it up to the next word; null texts stay null, texts without hits as they were.
    """
    windows = materialize(benchmark_windows(benchmark), "windows")
    of_id, of_text, of_runs = (unused(docs, name) for name in ("_id", "_key", "_runs"))
    spans = hits(docs, windows, max_broadcast).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "len")).alias(of_runs))
    spans = spans.withColumnRenamed("doc_id", of_id).withColumnRenamed("text_key", of_text)
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_text)), "left")
    lead = F.regexp_extract("text", "^" + BETWEEN, 0)
    parts = F.regexp_extract_all("text", F.lit(WORD + BETWEEN), F.lit(0))
    inside = F.array_distinct(F.flatten(F.transform(of_runs, lambda r: F.sequence(r["pos"], r["pos"] + r["len"] - 1))))
    left = F.filter(parts, lambda x, i: ~F.array_contains(inside, i))
    text = F.when(F.col(of_runs).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(left, "")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
