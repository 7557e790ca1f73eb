"""Forests from (id, parent) rows, their preorder, and places in a global order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.plans.scratch import materialize


def ranked(df: DataFrame, order: list[Column | str], place: str) -> DataFrame:
    """``df`` with the ``place`` of each row, from 0, in the order of all.

    Rows are sorted by ranges and numbered in their range; only the counts of the ranges, at most as many as shuffle
    partitions, meet in one task. Equal rows get neighbouring places in any order.
    """
    rows = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(place))


def forest(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """``nodes`` with ``parent_order``, the ``order`` of the row they hang on; null for roots.

    Rows without a parent, or with an unknown one, are roots. Of rows that share an id the first takes the children; all
    stay in the forest. ``order`` is distinct.
    """
    first = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("__id")).agg(F.min(order).alias("parent_order"))
    return nodes.join(first, F.col(parent) == F.col("__id"), "left").drop("__id")


def preorder(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """``nodes`` with depth and place (both from 0) in a walk that takes each root, then its children, by ``order``.

    Rows on a cycle, and what hangs on them, are reached from no root and left out. A round a level, each a table.
    """
    hung = materialize(forest(nodes, node, parent, order), "forest")
    step = hung.select(F.col("parent_order").alias("__up"), F.col(order).alias("__own"))
    levels = [materialize(step.where("__up IS NULL").select("__own", F.array("__own").alias("__path")), "level")]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("__own").alias("__up"), F.col("__path").alias("__above"))
        levels.append(materialize(step.join(above, "__up").select("__own", F.concat("__above", F.array("__own")).alias("__path")), "level"))
    paths = reduce(DataFrame.unionByName, levels)
    rows = nodes.join(paths, F.col(order) == F.col("__own")).withColumn("depth", F.size("__path") - 1)
    return ranked(rows, ["__path"], "place").select(*nodes.columns, "depth", "place")
