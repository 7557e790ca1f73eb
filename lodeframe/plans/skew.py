"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeframe.plans.scratch import materialize

#: A key is hot when it holds at least one part in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 10_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str, total: int, how: str = "inner", hot_share: int = HOT_SHARE) -> DataFrame:
    """Join ``rows`` (many per key) with ``per_key`` (one row per key), ``how`` being inner or left.

    ``weight`` is a column of ``per_key`` that bounds how many of ``rows`` carry the key and ``total`` bounds
    their sum. Keys with ``weight * hot_share >= total`` number at most ``hot_share`` whatever the size of the
    input, so they are broadcast; the others cannot be hot and go through an ordinary shuffled join.
    ``weight`` is dropped. Null keys match nothing. Both inputs are read twice: pass tables, not long plans.
    """
    hot = F.col(weight) * F.lit(hot_share) >= F.lit(int(total))
    few = F.broadcast(per_key.where(hot).drop(weight))
    rest = per_key.where(~hot).drop(weight)
    on_hot = rows.join(few, key)
    others = rows.join(F.broadcast(per_key.where(hot).select(key)), key, "left_anti")
    return on_hot.unionByName(others.join(rest, key, how))


def with_count(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` with the ``number`` of those that share their ``key``, counted before anything meets; null keys are left out."""
    rows = materialize(rows, "rows")
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    return join_per_key(rows, counts.withColumn(number, F.col("__n")), key, "__n", total)
