"""Which classes and members are due for a rename, and aliases for them.

Inputs are tables ``classes`` (name) and ``members`` (owner, pos, name, descriptor), names with slashes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.names import RESERVED, is_poor_name
from lodeframe.functions.predicates import any_of, package_of
from lodeframe.operators.trees import ranked

#: Prefixes of classes that keep their names.
KEPT_PREFIXES = ("java/", "javax/", "jdk/", "sun/", "com/sun/", "kotlin/", "kotlinx/", "android/", "androidx/")
#: Methods that keep their names.
KEPT_METHODS = ("<init>", "<clinit>", "main", "values", "valueOf")
ROOT_METHODS = ("toString", "hashCode", "equals", "clone", "finalize", "getClass", "notify", "notifyAll", "wait")
#: How methods begin that frameworks call.
CALLBACKS = ("on", "run", "call")


def _simple(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def keeps_names(name: Column) -> Column:
    """Library classes, ``R``, its inner classes, and ``BuildConfig``."""
    simple = _simple(name)
    return any_of([F.lower(name).startswith(p) for p in KEPT_PREFIXES]) | simple.isin("R", "BuildConfig") | simple.startswith("R$")


def _kept_part(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_$]", "")


def class_renames(classes: DataFrame) -> DataFrame:
    """(class_name, old_name, new_name): classes whose innermost name is poor or is a segment of some package.

    Aliases are ``C``, a number of four digits or more by name order, and what is plain of the old name. Numbered inner classes stay.
    """
    names = classes.select(F.col("name").alias("class_name")).where(F.col("class_name").isNotNull()).distinct()
    segments = names.select(F.explode(F.split(package_of(F.col("class_name")), "/")).alias("old_name")).where("old_name <> ''").distinct()
    own = names.where(~keeps_names(F.col("class_name"))).withColumn("old_name", F.substring_index(_simple(F.col("class_name")), "$", -1))
    own = own.where((F.btrim(_simple(F.col("class_name"))) != "") & ~(F.col("class_name").contains("$") & F.col("old_name").rlike(r"^\p{Nd}*\z")))
    poor = own.where(is_poor_name(F.col("old_name")))
    clash = own.where(~is_poor_name(F.col("old_name"))).join(segments, "old_name", "left_semi")
    due = ranked(poor.unionByName(clash), ["class_name"], "place")
    number = F.when(F.col("place") < 10_000, F.lpad(F.col("place").cast("string"), 4, "0")).otherwise(F.col("place").cast("string"))
    return due.select("class_name", "old_name", F.concat(F.lit("C"), number, _kept_part(F.col("old_name"))).alias("new_name"))


def due_members(members: DataFrame, methods: bool) -> DataFrame:
    """``members`` with a poor name, or that share their name (methods: and descriptor) with another of their class.

    A class has 65,535 fields and as many methods at most, which bounds the groups.
    """
    own = members.where(~keeps_names(F.col("owner")))
    same = Window.partitionBy("owner", "name", *(["descriptor"] if methods else []))
    due = own.withColumn("__n", F.count("*").over(same)).where(is_poor_name(F.col("name")) | (F.col("__n") > 1)).drop("__n")
    return due.where(~F.col("name").isin(*KEPT_METHODS, *ROOT_METHODS)) if methods else due


def _unused(group: pd.DataFrame) -> pd.DataFrame:
    """Aliases of one class that no member and no alias before has; the first of repeated members stays."""
    group = group.sort_values(["is_method", "pos"])
    used, found = set(group["used"].iloc[0]), []
    for alias in group["alias"]:
        name, n = alias, 2
        while name in used or name in RESERVED:
            name, n = f"{alias}_{n}", n + 1
        used.add(name)
        found.append(name)
    return group.assign(new_name=found).drop_duplicates(["is_method", "name", "descriptor"])[["owner", "is_method", "name", "descriptor", "new_name"]]


def member_renames(fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(owner, is_method, name, descriptor, new_name) of the members due: ``f``, ``m`` or, for likely overrides, ``mo``,
    a number by owner and position, and what is plain of the name; ``_2`` and so on where that is taken in the class."""
    likely = any_of([F.col("name").startswith(p) for p in CALLBACKS])
    parts = []
    for df, is_method, letter in ((fields, False, F.lit("f")), (methods, True, F.when(likely, "mo").otherwise("m"))):
        due = ranked(due_members(df.select("owner", "pos", "name", "descriptor"), is_method), ["owner", "pos"], "place")
        parts.append(due.withColumn("is_method", F.lit(is_method)).withColumn("alias", F.concat(letter, F.col("place").cast("string"), _kept_part(F.col("name")))))
    taken = fields.select("owner", "name").unionByName(methods.select("owner", "name")).groupBy("owner").agg(F.collect_set("name").alias("used"))
    rows = parts[0].unionByName(parts[1]).join(taken, "owner")
    return rows.groupBy("owner").applyInPandas(_unused, "owner string, is_method boolean, name string, descriptor string, new_name string")
