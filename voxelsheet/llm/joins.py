"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

HEAVY = 4096


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """Keys with more than one row in ``HEAVY``, stored: fewer than ``HEAVY`` of them. None if there are none."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    keys = materialize(counts.filter((F.col("_rows") > 1) & (F.col("_rows") > rows.count() / HEAVY)).select(key), "heavy")
    return None if keys.isEmpty() else keys


def spread_join(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of their one row in ``facts``; rows without one, and null keys, go.

    The keys of ``heavy`` meet their facts by broadcast, the others by a shuffle in which no key is
    large. Where there are such keys ``rows`` is read twice: hand in a stored table.
    """
    if heavy is None:
        return rows.join(facts, key)
    own = F.broadcast(heavy)
    large = rows.join(own, key, "left_semi").join(F.broadcast(facts.join(own, key, "left_semi")), key)
    return rows.join(own, key, "left_anti").join(facts, key).unionByName(large)
