"""A catalog over class tables: kinds, look-ups, statistics, interfaces and implementers, annotations, override orders.

Inputs are the tables of ``sources.classfile``: classes (name, modifiers, superclass, interfaces, is_record), members
(owner, pos, name, descriptor, modifiers), annotations (target_kind, owner, member, annotation) and edges (rel, src, dst).
Everything is joins and closures, in declared order where that matters; only the order of methods places the interfaces of a
class in a function of one array.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.functions.predicates import ANNOTATION, ENUM, INTERFACE, has_bits
from lodeframe.operators.graph import clean_edges, closure, ordered_closure
from lodeframe.plans.scratch import materialize

#: The class that all others extend, and the package whose annotations are not reported as meta-annotations.
ROOT, META_PACKAGE = "java/lang/Object", "java/lang/annotation/"
KINDS = ("standard", "interface", "interface_or_annotation", "annotation", "enum", "record")


def is_kind(kind: str, modifiers: Column, is_record: Column | None = None) -> Column:
    """An annotation has both bits; an interface is one without the annotation bit; standard is neither."""
    return {
        "standard": lambda: ~has_bits(modifiers, INTERFACE | ANNOTATION),
        "interface": lambda: has_bits(modifiers, INTERFACE) & ~has_bits(modifiers, ANNOTATION),
        "interface_or_annotation": lambda: has_bits(modifiers, INTERFACE),
        "annotation": lambda: has_bits(modifiers, ANNOTATION),
        "enum": lambda: has_bits(modifiers, ENUM),
        "record": lambda: F.coalesce(is_record, F.lit(False)),
    }[kind]()


def of_kind(classes: DataFrame, kind: str) -> DataFrame:
    return classes.where(is_kind(kind, F.col("modifiers"), F.col("is_record") if "is_record" in classes.columns else F.lit(False)))


def named(classes: DataFrame, *names: str) -> DataFrame:
    """Look-up by name; dots and slashes are the same."""
    return classes.where(F.translate("name", ".", "/").isin([n.replace(".", "/") for n in names]))


def implemented_interfaces(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Interfaces, and whatever else some class implements."""
    used = edges.where("rel = 'implements'").select(F.col("dst").alias("name"), F.lit(True).alias("__used")).distinct()
    return classes.join(used, "name", "left").where(F.col("__used").isNotNull() | is_kind("interface", F.col("modifiers"))).drop("__used")


def class_statistics(classes: DataFrame, fields: DataFrame, methods: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row of eight counters. Interfaces count annotations too, as both have the bit; standard is what has none of three bits."""
    m = F.col("modifiers")
    own = classes.agg(
        F.count("*").alias("total_classes"), F.count_if(has_bits(m, INTERFACE)).alias("interface_count"), F.count_if(has_bits(m, ANNOTATION)).alias("annotation_count"),
        F.count_if(has_bits(m, ENUM)).alias("enum_count"), F.count_if(~has_bits(m, INTERFACE | ANNOTATION | ENUM)).alias("standard_class_count"),
    )
    for name, df in (("total_fields", fields), ("total_methods", methods), ("total_annotations", annotations)):
        own = own.join(df.agg(F.count("*").alias(name)))
    return own


def first_member(members: DataFrame, name: str, descriptor: str | None = None) -> DataFrame:
    """The first member by position of each owner with a name, and a descriptor if one is given."""
    found = members.where(F.col("name") == name)
    found = found if descriptor is None else found.where(F.col("descriptor") == descriptor)
    return found.groupBy("owner").agg(F.min_by(F.struct(*members.columns), "pos").alias("m")).select("m.*")


def declared_methods(methods: DataFrame, name: str | None = None, normal: bool = True, constructors: bool = False, initializers: bool = False) -> DataFrame:
    """Methods by sort; with a name the switches do not matter."""
    if name is not None:
        return methods.where(F.col("name") == name)
    sort = F.when(F.col("name") == "<init>", constructors).when(F.col("name") == "<clinit>", initializers).otherwise(normal)
    return methods.where(sort)


def default_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Methods with a body whose owner is a pure interface, static ones included."""
    return methods.where("has_body").join(of_kind(classes, "interface").select(F.col("name").alias("owner")), "owner", "left_semi")


def enum_constants(fields: DataFrame) -> DataFrame:
    return fields.where(has_bits(F.col("modifiers"), ENUM))


def signature_counts(methods: DataFrame) -> DataFrame:
    """(name, descriptor, n): how many methods share a signature."""
    return methods.groupBy("name", "descriptor").agg(F.count("*").alias("n"))


def _of(edges: DataFrame, *rels: str) -> DataFrame:
    return edges.where(F.col("rel").isin(list(rels))).select("src", "dst")


def subclasses_of(classes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(name, is_direct) of all below a class; below the root class, which has no edges, are all standard classes."""
    if name == ROOT:
        return of_kind(classes, "standard").select("name", F.coalesce(F.col("superclass") == ROOT, F.lit(False)).alias("is_direct"))
    turned = _of(edges, "extends").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = classes.sparkSession.createDataFrame([(name,)], "src string")
    return closure(turned, roots).select(F.col("dst").alias("name"), "is_direct")


def all_interfaces(edges: DataFrame) -> DataFrame:
    """(name, interface, is_direct): those a class names, their super-interfaces, and all of its superclasses."""
    up = closure(_of(edges, "extends")).select(F.col("src").alias("name"), F.col("dst").alias("via"))
    own = closure(_of(edges, "implements")).select(F.col("src").alias("name"), F.col("dst").alias("interface"), "is_direct")
    late = up.join(own.withColumnRenamed("name", "via"), "via").select("name", "interface", F.lit(False).alias("is_direct"))
    return own.unionByName(late).groupBy("name", "interface").agg(F.bool_or("is_direct").alias("is_direct"))


def implementers(edges: DataFrame) -> DataFrame:
    """(interface, name, is_direct): classes and interfaces below an interface, and the subclasses of these."""
    return all_interfaces(edges).select("interface", "name", "is_direct")


def concrete_implementers(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(interface, name): classes that name an interface or one of its sub-interfaces, without their subclasses."""
    below = closure(_of(edges, "implements")).select(F.col("dst").alias("interface"), F.col("src").alias("name"))
    return below.join(of_kind(classes, "interface_or_annotation").select("name"), "name", "left_anti").select("interface", "name").distinct()


def enclosing_classes(edges: DataFrame) -> DataFrame:
    """(name, outer, depth): every class around an inner class, from ``outer`` edges; read backwards, its inner classes."""
    return closure(_of(edges, "outer")).select(F.col("src").alias("name"), F.col("dst").alias("outer"), "depth")


def with_overflow(df: DataFrame, group: Sequence[str], item: str, most: int) -> DataFrame:
    """(group, ordinal, item, n_more): the first ``most`` items by name, and one row more with the number of the others.

    Both are aggregates or ranks with a limit, so that a large group isn't gathered.
    """
    ranked = df.select(*group, item).withColumn("ordinal", F.row_number().over(Window.partitionBy(*group).orderBy(item)))
    first = ranked.where(F.col("ordinal") <= most).withColumn("n_more", F.lit(None).cast("long"))
    rest = df.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    more = rest.select(*group, F.lit(most + 1).alias("ordinal"), F.lit(None).cast(df.schema[item].dataType).alias(item), (F.col("__n") - most).alias("n_more"))
    return first.select(*group, "ordinal", item, "n_more").unionByName(more)


def meta_annotations(marks: DataFrame, meta: DataFrame) -> DataFrame:
    """(owner, annotation, is_direct) of (owner, annotation) rows, with the annotations of annotations.

    ``meta`` holds the (owner, annotation) rows of annotation classes. Those of the package of meta-annotations are
    reported only where they are direct.
    """
    above = closure(meta.select(F.col("owner").alias("src"), F.col("annotation").alias("dst"))).where(~F.col("dst").startswith(META_PACKAGE))
    direct = marks.select("owner", "annotation", F.lit(True).alias("is_direct")).distinct()
    late = direct.join(above.select(F.col("src").alias("annotation"), F.col("dst").alias("meta")), "annotation").select("owner", F.col("meta").alias("annotation"), F.lit(False).alias("is_direct"))
    return direct.unionByName(late).groupBy("owner", "annotation").agg(F.bool_or("is_direct").alias("is_direct"))


def class_annotations(annotations: DataFrame, edges: DataFrame, inherited: DataFrame) -> DataFrame:
    """(owner, annotation, is_direct): direct ones, meta-annotations, and the ``inherited`` (annotation) of superclasses."""
    marks = annotations.where("target_kind = 'class'").select("owner", "annotation")
    own = meta_annotations(marks, marks)
    up = closure(_of(edges, "extends")).select(F.col("src").alias("owner"), F.col("dst").alias("via"))
    handed = own.join(inherited.select("annotation").distinct(), "annotation", "left_semi").select(F.col("owner").alias("via"), "annotation")
    late = up.join(handed, "via").select("owner", "annotation", F.lit(False).alias("is_direct"))
    return own.unionByName(late).groupBy("owner", "annotation").agg(F.bool_or("is_direct").alias("is_direct"))


def inherited_annotations(annotations: DataFrame) -> DataFrame:
    """(annotation) that pass to subclasses: those marked as inherited themselves."""
    return annotations.where((F.col("target_kind") == "class") & (F.col("annotation") == META_PACKAGE + "Inherited")).select(F.col("owner").alias("annotation")).distinct()


def member_annotations(annotations: DataFrame, kind: str) -> DataFrame:
    """(owner, annotation, is_direct) over the fields, methods or parameters of each class, with meta-annotations."""
    rows = annotations.where(F.col("target_kind") == kind).select("owner", "annotation")
    return meta_annotations(rows, annotations.where("target_kind = 'class'").select("owner", "annotation"))


def unwrap_repeatable(annotations: DataFrame, containers: DataFrame) -> DataFrame:
    """``annotations`` whose ``containers`` (container, annotation) are replaced by the instances in their value, a JSON array.

    A container that is listed more than once counts once, with its first annotation by name. Spark broadcasts the containers
    where their size allows it.
    """
    known = containers.where("container IS NOT NULL").groupBy("container").agg(F.min("annotation").alias("__one"))
    rows = annotations.join(known, F.col("annotation") == F.col("container"), "left")
    inner = F.from_json(F.get_json_object("params", "$.value"), "array<struct<annotation:string,params:string>>")
    plain = rows.where("container IS NULL").select(*annotations.columns)
    taken = rows.where("container IS NOT NULL").select(*(c for c in annotations.columns if c != "params"), "__one", F.explode(inner).alias("__i"))
    return plain.unionByName(taken.withColumns({"annotation": F.col("__one"), "params": F.col("__i.params")}).select(*annotations.columns))


def ordered_interfaces(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(name, prio from 0, interface): the interfaces of each class (by default all) in the order of declarations.

    Those that it reaches itself come breadth-first, then in the same way those of its superclass, and so on up. ``edges``
    are (rel, src, dst, pos); ``roots`` is (name).
    """
    wanted = None if roots is None else roots.select(F.col("name").alias("src"))
    up = ordered_closure(edges.where("rel = 'extends'"), wanted).select(F.col("src").alias("name"), F.col("dst").alias("via"), F.col("depth").alias("above"))
    names = edges.select("src").union(edges.select("dst")).distinct() if roots is None else wanted.distinct()
    chain = materialize(up.unionByName(names.select(F.col("src").alias("name"), F.col("src").alias("via"), F.lit(0).alias("above"))), "chain")
    reach = ordered_closure(edges.where("rel = 'implements'"), chain.select(F.col("via").alias("src")))
    met = chain.join(reach.select(F.col("src").alias("via"), F.col("dst").alias("interface"), "depth", "path"), "via")
    first = met.groupBy("name", "interface").agg(F.min(F.struct("above", "depth", "path")).alias("way"))
    # A partition is the interfaces of one class.
    return first.select("name", (F.row_number().over(Window.partitionBy("name").orderBy("way")) - 1).alias("prio"), "interface")


def _placed(order: list[str], above: dict[str, list[str]]) -> list[str]:
    """Interfaces in the order given, each followed by what it extends, and placed before the first of those already there."""
    out: list[str] = []
    todo = order[::-1]
    while todo:
        face = todo.pop()
        if face not in out:
            own = above[face]
            places = {x: i for i, x in enumerate(out)}
            out.insert(min((places[x] for x in own if x in places), default=len(out)), face)
            todo += own[::-1]
    return out


def _reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name) of ``roots`` and all that any of them reaches over (src, dst): sets of nodes, not pairs."""
    known = fresh = roots
    while not fresh.isEmpty():
        next_ = edges.select("src", F.col("dst").alias("to")).join(fresh.select(F.col("name").alias("src")), "src", "left_semi").where("to IS NOT NULL")
        fresh = materialize(next_.select(F.col("to").alias("name")).distinct().join(known, "name", "left_anti"), "fresh")
        known = known.unionByName(fresh)
    return materialize(known, "around")


def override_order(edges: DataFrame, kinds: DataFrame, fields: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """(name, prio from 0, declares): where each class looks for members, in order.

    ``edges`` are (rel, src, dst, pos) with the relations extends and implements, pos being the place of an interface in its
    declaration; ``kinds`` is (name, is_interface) of all classes; ``roots`` (name) are the classes asked for, by default all of
    ``kinds``. The interfaces of a class are those of ``ordered_interfaces``, so they hold those that its interfaces extend and
    those of its superclasses. Fields: a depth-first walk through the interfaces and then the superclass. Methods: the class and
    its superclasses, then interfaces, those of the topmost superclass first, and an interface before those that it extends.
    The interfaces of one class are one array, placed by a small function a row.
    """
    asked = materialize((kinds if roots is None else roots).select("name").distinct(), "asked")
    around = _reachable(edges.where("rel IN ('extends', 'implements')"), asked)
    faces = materialize(ordered_interfaces(edges, around), "faces")
    itself = asked.select("name", F.lit(0).alias("prio"), F.col("name").alias("declares"))
    if fields:
        links = faces.select(F.col("name").alias("src"), F.col("interface").alias("dst"), F.col("prio").alias("pos"))
        last = edges.where("rel = 'extends'").join(around.select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst", F.lit((1 << 31) - 1).alias("pos"))
        walk = ordered_closure(links.unionByName(last), asked.select(F.col("name").alias("src")), breadth=False)
        ranked = walk.select(F.col("src").alias("name"), F.row_number().over(Window.partitionBy("src").orderBy("path")).alias("prio"), F.col("dst").alias("declares"))
        return itself.unionByName(ranked)
    up = materialize(ordered_closure(edges.where("rel = 'extends'"), asked.select(F.col("name").alias("src"))).select(F.col("src").alias("name"), F.col("depth").alias("prio"), F.col("dst").alias("declares")), "chain")
    chain = itself.unionByName(up)
    # Interfaces in the order in which they are met from the topmost superclass down.
    met = chain.join(faces.select(F.col("name").alias("declares"), F.col("prio").alias("place"), "interface"), "declares")
    seen = met.groupBy("name", "interface").agg(F.min(F.struct((-F.col("prio")).alias("down"), "place")).alias("way"))
    own = faces.groupBy(F.col("name").alias("interface")).agg(F.transform(F.sort_array(F.collect_list(F.struct("prio", "interface"))), lambda x: x["interface"]).alias("own"))
    length = up.groupBy("name").agg(F.max("prio").alias("length"))
    rows = seen.join(own, "interface", "left").select("name", "way.down", "way.place", "interface", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    listed = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("down", "place", "interface", "own"))).alias("all")).select("name", "all.interface", "all.own")

    @F.pandas_udf("array<string>")
    def placed(faces: pd.Series, above: pd.Series) -> pd.Series:
        return pd.Series([_placed(list(x), dict(zip(x, map(list, y)))) for x, y in zip(faces, above)])

    # One array a class: a group a class would cost a call of Python and pandas each.
    ordered = listed.select("name", placed("interface", "own").alias("all")).join(length, "name", "left")
    ordered = ordered.select("name", "length", F.posexplode("all").alias("at", "declares"))
    return chain.unionByName(ordered.select("name", (F.coalesce("length", F.lit(0)) + 1 + F.col("at")).cast("int").alias("prio"), "declares"))


def visible_members(orders: DataFrame, members: DataFrame, key: Sequence[str]) -> DataFrame:
    """(name of the class, the member's columns): the first member of each key along the override order.

    Constructors count only for the class itself.
    """
    rows = orders.withColumnRenamed("name", "class_name").join(members.withColumnRenamed("owner", "declares"), "declares")
    rows = rows.where((F.col("name") != "<init>") | (F.col("prio") == 0))
    best = rows.groupBy("class_name", *key).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("class_name", *key))), "prio").alias("m"))
    return best.select("class_name", *key, "m.*").withColumnRenamed("declares", "owner").drop("prio")


def has_member(orders: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """(name) of the classes that see a member of that name."""
    found = members.where(F.col("name") == name).select(F.col("owner").alias("declares"))
    return orders.join(found, "declares", "left_semi").select("name").distinct()


def has_member_annotation(orders: DataFrame, annotations: DataFrame, kind: str, annotation: str) -> DataFrame:
    """(name) of the classes that see a member of a kind with an annotation."""
    found = annotations.where((F.col("target_kind") == kind) & (F.col("annotation") == annotation)).select(F.col("owner").alias("declares"))
    return orders.join(found, "declares", "left_semi").select("name").distinct()


def parse_target(query: str) -> tuple[str, str, str | None] | None:
    """(whole, class part, member part) of a ``Class#member`` query, lower-cased with slashes; None without a class."""
    raw = query.strip().removesuffix(".class").replace("\\", "/").lower().replace(".", "/").replace("$", "/")
    owner, mark, member = raw.rpartition("#")
    owner, found = (owner, member) if mark else (raw, None)
    return (raw, owner, found) if owner.strip() else None


def matches_class(target: tuple, owner: Column) -> Column:
    """The owner's name holds the class part, or its simple name and the query hold one another."""
    low = F.translate(F.lower(owner), "$", "/")
    simple = F.substring_index(low, "/", -1)
    return F.coalesce((F.trim(low) != "") & (low.contains(target[1]) | simple.contains(target[0]) | F.lit(target[0]).contains(simple)), F.lit(False))


def matches_member(target: tuple, owner: Column, name: Column) -> Column:
    """The name holds the member part and the owner matches; without a member part, the name holds the query."""
    low = F.lower(name)
    found = low.contains(target[0]) if target[2] is None else low.contains(target[2]) & matches_class(target, owner)
    return F.coalesce((F.trim(low) != "") & found, F.lit(False))


def matches_descriptor(target: tuple, descriptor: Column) -> Column:
    """The descriptor names the class part, or a class with its simple name, which may also begin after any ``l`` of a name."""
    low, simple = F.lower(descriptor), target[1].rpartition("/")[2]
    found = low.contains(f"l{target[1]};")
    if simple:
        found = found | low.rlike("l([^;]*/)?" + re.escape(simple) + ";")
    return F.coalesce(found, F.lit(False))


def find_usages(references: DataFrame, query: str) -> DataFrame:
    """Rows of ``references`` (op, owner, name, descriptor, ...) that use the class or member of a query.

    op is CLASS, METHOD_CALL, FIELD_ACCESS or FIELD; a query without a class, as ``#member``, finds nothing.
    """
    target = parse_target(query)
    if target is None:
        return references.where(F.lit(False))
    owner, name, text = F.col("owner"), F.col("name"), F.col("descriptor")
    member = F.col("op").isin("METHOD_CALL", "FIELD_ACCESS") & matches_member(target, owner, name)
    if target[2] is not None:
        return references.where(member)
    return references.where(member | matches_class(target, owner) | matches_descriptor(target, text))
