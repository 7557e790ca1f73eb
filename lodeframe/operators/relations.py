"""Set algebra with direct membership, first-wins masking, grouping, annotations, members and cross-references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.predicates import any_of, package_of
from lodeframe.plans.skew import with_count


def _member(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.bool_or("is_direct").alias("is_direct"))


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """(name, is_direct) in any input; direct if direct in one."""
    for o in others:
        first = first.unionByName(o)
    return _member(first)


def intersect(first: DataFrame, *others: DataFrame) -> DataFrame:
    """(name, is_direct) in every input; direct if direct in all."""
    out = _member(first)
    for o in others:
        out = out.join(_member(o).withColumnRenamed("is_direct", "__d"), "name").select("name", (F.col("is_direct") & F.col("__d")).alias("is_direct"))
    return out


def exclude(first: DataFrame, other: DataFrame) -> DataFrame:
    """(name, is_direct) of ``first`` not reachable in ``other``."""
    return _member(first).join(other.select("name"), "name", "left_anti")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``: an aggregate, so tasks merge copies before they shuffle."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of values that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def group_by_package(df: DataFrame, name: str, separator: str = "/") -> DataFrame:
    """(package, n) by what stands before the last separator."""
    return df.groupBy(package_of(F.col(name), separator).alias("package")).agg(F.count("*").alias("n"))


def statistics(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and how many rows meet each condition."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def annotated_with_all(annotations: DataFrame, owner: str, annotation: str, wanted: Sequence) -> DataFrame:
    """(owner) with every one of the wanted annotations."""
    found = annotations.where(F.col(annotation).isin(list(wanted))).groupBy(owner).agg(F.count_distinct(annotation).alias("n"))
    return found.where(F.col("n") == len(set(wanted))).select(owner)


def annotated_with_any(annotations: DataFrame, owner: str, annotation: str, wanted: Sequence) -> DataFrame:
    """(owner) with at least one of the wanted annotations."""
    return annotations.where(F.col(annotation).isin(list(wanted))).select(owner).distinct()


def resolve_members(members: DataFrame, owner: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The member that each owner sees for a key: the first along the resolution order, with the number it hides."""
    whole = F.struct(*members.columns)
    out = members.groupBy(owner, *key).agg(F.min_by(whole, F.struct(*order)).alias("__row"), (F.count("*") - 1).alias("n_hidden"))
    return out.select("__row.*", "n_hidden")


def dependencies(refs: DataFrame, src: str, dst: str) -> DataFrame:
    """(name, uses, n): distinct targets of each source, a row each, with their number; self references are left out."""
    pairs = refs.select(F.col(src).alias("name"), F.col(dst).alias("uses")).where("name <> uses").distinct()
    return with_count(pairs, "name", "n")


def externals(refs: DataFrame, ref: str, known: DataFrame, name: str) -> DataFrame:
    """(name) that are referred to but not known."""
    return refs.select(F.col(ref).alias("name")).where("name is not null").distinct().join(known.select(F.col(name).alias("name")), "name", "left_anti")


def usages(lines: DataFrame, column: str, targets: Sequence[str]) -> DataFrame:
    """``lines`` that mention one of the targets as plain text."""
    return lines.where(any_of([F.col(column).contains(t) for t in targets]))


def enclosing_regions(points: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """(point, region, start, length): regions [start, start + length) around each point.

    Both sides meet in cells. A region is filed by cells of ``width``, doubled until they are as long as it, so it
    enters two or three cells whatever its length; a point looks in one cell of each size in use, 63 at most. Each
    match is found once. Choose ``width`` near the usual region length.
    """
    most = 62 - int(width).bit_length()
    steps = F.least(F.greatest(F.ceil(F.log2(F.col("length") / width)), F.lit(0)), F.lit(most)).cast("int")
    filed = regions.where("length > 0").withColumn("__size", F.call_function("shiftleft", F.lit(int(width)).cast("long"), steps))
    cell = lambda at: at - F.pmod(at, F.col("__size"))
    start, last = F.col("start").cast("long"), (F.col("start") + F.col("length") - 1).cast("long")
    cells = filed.withColumn("__cell", F.explode(F.sequence(cell(start), cell(last), F.col("__size"))))
    sizes = sorted(r[0] for r in filed.select("__size").distinct().collect())
    at = points.withColumn("__size", F.explode(F.array(*map(F.lit, sizes)).cast("array<bigint>"))).withColumn("__cell", cell(F.col("point").cast("long")))
    return at.join(cells, ["__size", "__cell"]).where("point >= start AND point < start + length").drop("__size", "__cell")


def region_chain(points: DataFrame, regions: DataFrame, width: int, ordinal: str | None = None) -> DataFrame:
    """(point, depth from 0, region, start, length) of the regions around each distinct point, from the largest to the smallest.

    Of regions of one length that with the largest ``ordinal`` (by default the name) is the outer one. A partition is the
    regions around one point.
    """
    tie = [F.desc(ordinal)] if ordinal else [F.desc("region")]
    found = enclosing_regions(points.select("point").where("point IS NOT NULL").distinct(), regions, width)
    order = Window.partitionBy("point").orderBy(F.desc("length"), *tie)
    return found.select("point", (F.row_number().over(order) - 1).alias("depth"), "region", "start", "length")


def region_paths(points: DataFrame, regions: DataFrame, width: int, ordinal: str | None = None, separator: str = " > ") -> DataFrame:
    """(point, n_regions, path, innermost) of each distinct point in a region: the names of all regions around it, outermost first.

    A path is as long as its nest of regions is deep.
    """
    rows = region_chain(points, regions, width, ordinal).groupBy("point").agg(F.sort_array(F.collect_list(F.struct("depth", F.col("region").cast("string").alias("name")))).alias("all"))
    names = F.transform("all", lambda x: x["name"])
    return rows.select("point", F.size("all").alias("n_regions"), F.array_join(names, separator).alias("path"), F.element_at(names, -1).alias("innermost"))


def nearest_after(queries: DataFrame, marks: DataFrame, key: str, at: str, value: str, strict: bool = True, chunk: int = 1_000_000) -> DataFrame:
    """Each query row with the value of the first mark of its key after it (null if there is none); not ``strict``: at or after it.

    ``at`` is an integer. This is ``nearest_before`` on the line turned around; of marks at one place the largest counts.
    """
    turned = lambda df: df.withColumn("__turned", -F.col(at).cast("long"))
    own = turned(queries).withColumn("__turned", F.col("__turned") - (1 if strict else 0))
    return nearest_before(own, turned(marks).select(key, "__turned", value), key, "__turned", value, chunk).drop("__turned")


def nearest_before(queries: DataFrame, marks: DataFrame, key: str, at: str, value: str, chunk: int = 1_000_000) -> DataFrame:
    """Each query row with the value of the last mark of its key at or before it (null if there is none).

    Queries and marks are sorted together in ranges of ``chunk`` along the integer ``at``, and the last mark of each
    range is carried to the ranges of its key after it, so no task sorts a whole key and no pairs are formed. Null
    values are no marks; of marks at one place the largest counts. Null keys are a key, and a null ``at`` comes first.
    """
    both = queries.withColumn("__mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__own", F.lit(1))
    other = marks.where(F.col(value).isNotNull()).select(
        *(F.col(c) if c in (key, at) else F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in queries.columns), F.col(value).alias("__mark"), F.lit(0).alias("__own")
    )
    rows = both.unionByName(other).withColumn("__cell", F.floor(F.col(at) / chunk))
    order = F.struct(F.col(at).isNotNull(), at, "__mark")
    ends = rows.groupBy(F.col(key).alias("__key"), F.col("__cell").alias("__at")).agg(F.max_by("__mark", F.when(F.col("__own") == 0, order)).alias("__end"))
    above = Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__key", "__at", F.last("__end", ignorenulls=True).over(above).alias("__carried"))
    inside = Window.partitionBy(key, "__cell").orderBy(at, "__own", "__mark").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__last", F.last("__mark", ignorenulls=True).over(inside)).where("__own = 1")
    joined = filled.join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__cell").eqNullSafe(F.col("__at")))
    return joined.select(*queries.columns, F.coalesce("__last", "__carried").alias(value))
