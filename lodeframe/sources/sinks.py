"""What an export writes: safe relative paths, conflict policies and counts; the files themselves are Spark's to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.predicates import package_of

POLICIES = ("SKIP", "OVERWRITE", "RENAME")


def safe_path(path: Column) -> Column:
    """A relative path with ``/`` and without empty or ``.`` levels; null where it is absolute, climbs with ``..`` or has a drive or a NUL."""
    slashed = F.translate(path, "\\", "/")
    levels = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))
    bad = slashed.startswith("/") | slashed.rlike(r"^[A-Za-z]:") | slashed.contains("\0") | F.array_contains(levels, "..") | (F.size(levels) == 0)
    return F.when(~bad, F.array_join(levels, "/"))


def numbered(df: DataFrame, key: str, order: str, number: str, chunk: int = 1_000_000) -> DataFrame:
    """``df`` with the position, from 1, of each row among those of its ``key`` by the integer ``order``.

    Rows are counted in ranges of ``chunk`` ids first, so no task sorts a whole key, however large.
    """
    cell = F.floor(F.col(order) / chunk).alias("__cell")
    counts = df.groupBy(F.col(key).alias("__key"), cell).agg(F.count("*").alias("__n"))
    above = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__key", F.col("__cell").alias("__at"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__cell").orderBy(order)
    rows = df.withColumn("__cell", cell).withColumn("__own", F.row_number().over(inside))
    joined = rows.join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__cell").eqNullSafe(F.col("__at")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__own")).alias(number))


def export_plan(df: DataFrame, path: str, order: str, policy: str, chunk: int = 1_000_000) -> DataFrame:
    """``df`` with target, package and action of each row.

    Rows without a safe path are rejected. Of rows with the same target, in integer ``order``, SKIP writes the first
    and OVERWRITE the last, the others being skipped; RENAME writes all, the second as ``name_2.ext`` and so on.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    rows = df.withColumn("target", safe_path(F.col(path)))
    good = rows.where(F.col("target").isNotNull())
    if policy == "RENAME":
        stem, end = F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("target", r"(\.[^./]*)?$", 1)
        again = F.when(F.col("__number") == 1, F.col("target")).otherwise(F.concat(stem, F.lit("_"), F.col("__number").cast("string"), end))
        good = numbered(good, "target", order, "__number", chunk).withColumn("target", again).drop("__number").withColumn("action", F.lit("write"))
    else:
        chosen = good.groupBy("target").agg((F.min if policy == "SKIP" else F.max)(order).alias("__chosen"))
        good = good.join(chosen, "target").withColumn("action", F.when(F.col(order) == F.col("__chosen"), "write").otherwise("skip")).select(*rows.columns, "action")
    out = good.unionByName(rows.where(F.col("target").isNull()).withColumn("action", F.lit("reject")))
    return out.withColumn("package", package_of(F.col("target")))


def export_counts(plan: DataFrame) -> DataFrame:
    """One row: how many rows were written, skipped and rejected."""
    return plan.agg(*(F.count_if(F.col("action") == a).alias(name) for a, name in (("write", "written"), ("skip", "skipped"), ("reject", "rejected"))))


def export_tables(plan: DataFrame, folder: str) -> None:
    """The rows to write, as Parquet below ``folder``, one directory per package; earlier packages of the same name are replaced."""
    plan.where("action = 'write'").drop("action").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").parquet(folder)
