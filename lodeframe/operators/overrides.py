"""Which methods override, are overridden or are inherited, and the grouped report about a class.

Inputs are the tables ``methods`` (owner, name, descriptor, modifiers) and ``edges`` (rel, src, dst) with the
relations extends, implements and annotated. All answers are joins on (name, descriptor) along a closure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.predicates import FINAL, PRIVATE, STATIC, has_bits
from lodeframe.operators.graph import closure, components

#: Prefixes of library classes, which end a search for overridden methods; rows of a group in a report.
LIBRARY = ("java/", "javax/")
MOST_CLASSES, MOST_METHODS = 200, 50
#: The groups of a report, in its order.
GROUPS = ("SUPER_CLASS", "INTERFACE", "ANNOTATION", "OVERRIDES", "OVERRIDDEN_BY", "INHERITED", "IMPLEMENTATION", "SUBCLASS", "ANNOTATED")


def is_overridable(name: Column, modifiers: Column) -> Column:
    """Neither constructor nor initialiser, nor static, private or final."""
    return ~name.startswith("<") & ~has_bits(modifiers, STATIC | PRIVATE | FINAL)


def _signatures(methods: DataFrame, owner: str) -> DataFrame:
    return methods.where(is_overridable(F.col("name"), F.col("modifiers"))).select(F.col("owner").alias(owner), "name", "descriptor").distinct()


def _known(edges: DataFrame, rels: Sequence[str]) -> DataFrame:
    ups = edges.where(F.col("rel").isin(list(rels)))
    for prefix in LIBRARY:
        ups = ups.where(~F.col("dst").startswith(prefix))
    return ups.select("src", "dst")


def ancestors(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): the chain of superclasses, and the interfaces that a class itself names; no library classes."""
    up = closure(_known(edges, ["extends"])).select("src", "dst", "depth")
    both = up.unionByName(_known(edges, ["implements"]).withColumn("depth", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def overrides(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, name, descriptor, base): overridable methods that an ancestor has too; base is the nearest, ties by name."""
    own, above = _signatures(methods, "owner"), _signatures(methods, "base")
    up = ancestors(edges).select(F.col("src").alias("owner"), F.col("dst").alias("base"), "depth")
    found = own.join(up, "owner").join(above, ["base", "name", "descriptor"])
    best = found.groupBy("owner", "name", "descriptor").agg(F.min(F.struct("depth", "base")).alias("m"))
    return best.select("owner", "name", "descriptor", F.col("m.base").alias("base"))


def families(found: DataFrame) -> DataFrame:
    """(owner, name, descriptor, family) of methods that override or are overridden; ``found`` is ``overrides``.

    A family is what overrides connect, and is known by its smallest owner, name and descriptor, written ``owner.name()V``.
    """
    key = lambda owner: F.concat(owner, F.lit("."), F.col("name"), F.col("descriptor"))
    edges = found.select(key(F.col("owner")).alias("a"), key(F.col("base")).alias("b"), "owner", "base", "name", "descriptor")
    members = edges.select("owner", "name", "descriptor").union(edges.select("base", "name", "descriptor")).distinct()
    members = members.withColumn("node", key(F.col("owner")))
    return members.join(components(edges), "node", "left").select("owner", "name", "descriptor", F.coalesce("component", "node").alias("family"))


def overridden_by(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, name, descriptor, sub): overridable methods and the descendants that declare them too."""
    below = closure(edges.where("rel IN ('extends', 'implements')")).select(F.col("dst").alias("owner"), F.col("src").alias("sub"))
    again = methods.select(F.col("owner").alias("sub"), "name", "descriptor").distinct()
    return _signatures(methods, "owner").join(below, "owner").join(again, ["sub", "name", "descriptor"]).select("owner", "name", "descriptor", "sub")


def inherited(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, name, descriptor, base): overridable methods of the direct parents that a class doesn't declare.

    Of several parents with the method the superclass comes first, then interfaces by name. Interfaces as owners
    are the caller's to leave out.
    """
    direct = edges.where("rel IN ('extends', 'implements')").select(F.col("src").alias("owner"), F.col("dst").alias("base"), (F.col("rel") == "implements").alias("late")).distinct()
    found = direct.join(_signatures(methods, "base"), "base").join(_signatures(methods, "owner"), ["owner", "name", "descriptor"], "left_anti")
    return found.groupBy("owner", "name", "descriptor").agg(F.min(F.struct("late", "base")).alias("m")).select("owner", "name", "descriptor", F.col("m.base").alias("base"))


def class_report(roots: DataFrame, methods: DataFrame, edges: DataFrame, most_classes: int = MOST_CLASSES, most_methods: int = MOST_METHODS) -> DataFrame:
    """(root, kind, ordinal, item) for each class of ``roots`` (name): the groups of ``GROUPS``, those without items absent.

    Items are class names, or owner.name+descriptor for methods, by name within a group, and cut at the given
    numbers, which are limits of the report itself.
    """
    root = roots.select(F.col("name").alias("root")).distinct()

    def group(kind: str, df: DataFrame, owner: str, item: Column) -> DataFrame:
        rows = df.select(F.col(owner).alias("root"), item.alias("item")).join(root, "root", "left_semi").distinct()
        return rows.select("root", F.lit(kind).alias("kind"), F.lit(GROUPS.index(kind)).alias("at"), "item")

    # Only what lies below the classes asked for.
    def down(*rels: str) -> DataFrame:
        turned = edges.where(F.col("rel").isin(*rels)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return closure(turned, root.select(F.col("root").alias("src")))

    subclasses, below = down("extends"), down("extends", "implements")
    interfaces = edges.where("rel = 'implements'").select(F.col("dst").alias("src")).distinct()
    method = lambda owner: F.concat(F.col(owner), F.lit("."), "name", "descriptor")
    out = group("SUPER_CLASS", edges.where("rel = 'extends'"), "src", F.col("dst"))
    for part in (
        group("INTERFACE", edges.where("rel = 'implements'"), "src", F.col("dst")),
        group("ANNOTATION", edges.where("rel = 'annotated'"), "src", F.col("dst")),
        group("OVERRIDES", overrides(methods, edges), "owner", method("base")),
        group("OVERRIDDEN_BY", overridden_by(methods, edges), "owner", method("sub")),
        group("INHERITED", inherited(methods, edges), "owner", method("base")),
        group("IMPLEMENTATION", below.join(interfaces, "src", "left_semi"), "src", F.col("dst")),
        group("SUBCLASS", subclasses.join(interfaces, "src", "left_anti"), "src", F.col("dst")),
        group("ANNOTATED", edges.where("rel = 'annotated'"), "dst", F.col("src")),
    ):
        out = out.unionByName(part)
    most = F.when(F.col("kind").isin("OVERRIDES", "OVERRIDDEN_BY", "INHERITED"), most_methods).otherwise(most_classes)
    ranked = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("root", "kind").orderBy("item")))
    # The first condition, on a literal, lets each task keep only so many rows of a group before the shuffle.
    return ranked.where((F.col("ordinal") <= max(most_classes, most_methods)) & (F.col("ordinal") <= most)).select("root", "kind", "ordinal", "item")
