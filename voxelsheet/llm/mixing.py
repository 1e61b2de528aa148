"""Mixing sources to target weights on built-in functions only.

Efraimidis-Spirakis keys (an exponential draw divided by the document's
quality weight) order each source; words are summed along that order up to the
source's budget. Complete epochs come first, the rest is selected by key. The
order is cut into key ranges by Spark's range partitioning, so no source,
however large, is ordered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import number_rows, running
from ..session import materialize
from .arrow import unused

WEIGHTS = (5, 2, 1)
TOKEN = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[!#$%&*|<>{}\[\]^~_=+@]"


def word_count() -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("bigint")


def quality_weight() -> Column:
    """0.05 to 1: four times the share of symbols is taken off."""
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("double")
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * symbols / F.greatest(F.lit(1.0), F.length(text).cast("double")))


def sampling_key(weight: Column) -> Column:
    """-ln(u) / weight, u drawn from the id (from the text where the id is null)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    draw = F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("bigint").cast("double")
    return -F.log((draw + F.lit(0.5)) / F.lit(281474976710656.0)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target of each source.

    Sources in code point order, null last, take the weights in turn and share
    ``total`` times all words; none gets more than ``limit`` times its own, the
    excess is shared anew. Only three sums come to the driver per round.
    """
    order = F.col("source").asc_nulls_last()
    bucket = F.coalesce(F.rpad(F.hex(F.substring(F.encode("source", "UTF-8"), 1, 3)), 6, "0"), F.lit("X"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    ranked = number_rows(sizes, bucket, [order]).select("source", "source_size", weight.alias("w"), (F.col("source_size") * limit).alias("most"))
    ranked = materialize(ranked, "sources")
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("most") < F.lit(level) * F.col("w")
        row = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        following = (total * everything - (row.used or 0.0)) / row.open if row.open else level
        if following <= level:
            break
        level = following
    return ranked.select("source", "source_size", F.round(F.least(F.col("most"), F.lit(max(level, 0.0)) * F.col("w")), 6).alias("target"))


def _group() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _with_shares(df: DataFrame, shares: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """Add the columns of the source; sources are broadcast up to a counted number."""
    group = unused(df, "_g")
    other = shares.withColumn(group, _group()).drop("source")
    if other.count() <= max_broadcast:
        other = F.broadcast(other)
    return df.join(other, _group() == F.col(group)).drop(group)


def plan_mix(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, limit: float = 2.0,
             weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Document rows (doc_id, source, size, key), and per source: source_size, target, epochs, last key taken."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), sampling_key(quality_weight() if weight is None else weight).alias("key"))
    rows = materialize(rows, "sizes")  # the ranges are drawn from narrow rows: texts are read once
    ranged = materialize(rows.repartitionByRange("source", "key", "doc_id").withColumn("bucket", F.spark_partition_id()), "keys")
    sizes = ranged.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sizes, weights, total, limit)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    shares = shares.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    summed = running(ranged.withColumn("grp", _group()), F.col("bucket"), ["key", F.col("doc_id").asc_nulls_first()],
                     {"before": ("sum", F.col("size"))}, by=["grp"], inclusive=False)
    taken = _with_shares(summed, shares).filter((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")))
    last = taken.groupBy("grp").agg(F.max(F.struct("key", F.col("doc_id").alias("id"))).alias("last"))
    cuts = shares.withColumn("grp", _group()).join(last, "grp", "left").drop("grp", "rest")
    return ranged.drop("bucket"), materialize(cuts, "cuts")


def _copies(key: Column, epochs: str = "epochs", last: str = "last") -> Column:
    """Times a document is taken: all whole epochs, once more up to the last key."""
    chosen = F.struct(key.alias("key"), F.col("doc_id").alias("id")) <= F.col(last)
    return F.col(epochs) + F.when(chosen, F.lit(1)).otherwise(F.lit(0))


def mixture(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, limit: float = 2.0, weight: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``weight`` is a column of ``docs`` above 0, such as a stored quality score; without it the share
    of symbols in the text tells how likely a document is taken once more.
    ``taken`` is the document's words times the copies the mix takes. Null
    texts have size 0, null sources form one source, an empty table gives no
    rows. Rows equal in id share their draw, and equal rows their fate. Reruns
    agree, as draws depend on ids alone.
    """
    rows, cuts = plan_mix(docs, weights, total, limit, weight)
    joined = _with_shares(rows, cuts)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("key"))).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = 1.5, limit: float = 2.0, weight: Column | None = None) -> DataFrame:
    """The mixed corpus: every taken document once per copy, numbered by the added column ``copy`` from 1.

    Texts are not shuffled; the key is drawn anew and compared with the last one taken of the source.
    ``weight`` as in :func:`mixture`. All columns of ``docs`` stay; where one is named ``copy`` already, the
    added one is ``copy_``. Null texts have no words and are taken as often as their source, a null
    source is one of its own, repeated rows share their fate, an empty table stays empty.
    """
    _, cuts = plan_mix(docs, weights, total, limit, weight)
    epochs, last, copy = (unused(docs, name) for name in ("_epochs", "_last", "copy"))
    joined = _with_shares(docs, cuts.select("source", F.col("epochs").alias(epochs), F.col("last").alias(last)))
    copies = _copies(sampling_key(quality_weight() if weight is None else weight), epochs, last)
    return joined.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*docs.columns, copy)
