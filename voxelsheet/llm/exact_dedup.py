"""Exact duplicates by two-pass Bloom filtering.

The first pass marks text hashes in a filter of repeated slots
(:mod:`.bloom`); in the second, rows the filter clears are known to be single
and pass straight through. Only rows that may be repeated are shuffled, by
their SHA-256, and grouped with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .arrow import unused
from .bloom import maybe_repeated
from .joins import heavy_keys, spread_join

def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _order(row_id: str):
    """Rows without an id rank below all others."""
    return F.struct(F.col(row_id).isNotNull().alias("known"), F.col(row_id).alias("id"))


def duplicates(docs: DataFrame, max_bits: int = 28) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, null counts as empty. Of equal texts the
    row with the largest doc_id stays; a null doc_id ranks lowest. Of repeated
    rows (same text and doc_id) exactly one is kept. Empty table: no rows.
    """
    hashed = docs.select("doc_id", F.xxhash64(_text()).alias("h"), F.sha2(_text(), 256).alias("text_sha256"))
    check = maybe_repeated(docs.select(F.xxhash64(_text()).alias("h")), max_bits)
    # written once: the row number is then fixed, and the texts are not hashed again
    marked = materialize(hashed.select("doc_id", "text_sha256", check(F.col("h")).alias("maybe"),
                                       F.monotonically_increasing_id().alias("row")), "hashed")
    single = marked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.filter("maybe")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct(_order("doc_id").alias("o"), "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    # an empty text, say, may be that of a third of the rows
    repeated = spread_join(maybe, groups, "text_sha256", heavy_keys(maybe, "text_sha256")).select(
        "doc_id", F.col("top.o.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256")
    return single.unionByName(repeated)


def keep_one(docs: DataFrame, max_bits: int = 28) -> DataFrame:
    """The documents with the copies removed, all columns as they were.

    Rows the filter clears are not shuffled. Of the others the largest doc_id
    per text is found on narrow rows, and full rows meet it by text and id, so
    a text with very many copies is spread by the ids. Null and empty texts are
    one text, null ids rank lowest; of rows equal in text and id one stays, any of them where their other
    columns differ. An empty table stays empty.
    """
    columns = docs.columns
    own_id, own_sha, other_sha = (unused(docs, name) for name in ("_id", "_sha", "_own"))
    h, sha = F.xxhash64(_text()), F.sha2(_text(), 256)
    check = maybe_repeated(docs.select(h.alias("h")), max_bits)
    maybe = docs.filter(check(h))
    single = docs.filter(~check(h))
    narrow = maybe.select(F.col("doc_id").alias("id"), sha.alias(own_sha))
    top = narrow.groupBy(own_sha).agg(F.max(_order("id")).alias("top")).select(own_sha, F.col("top.id").alias(own_id))
    rows = maybe.withColumn(other_sha, sha)
    kept = rows.join(top, (F.col(other_sha) == F.col(own_sha)) & F.col("doc_id").eqNullSafe(F.col(own_id)))
    one = kept.groupBy(own_sha, own_id).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return single.unionByName(one)
