"""Uses of classes and members in code: usage search, and the graph of methods, fields and classes that use one another.

Inputs are the tables of ``sources.classfile`` and ``sources.bytecode``. A use is resolved to the class that declares the member
through override orders, which are joins; targets are made distinct first, and uses meet their resolved target by
``join_per_key``, so that a target that all methods call (the root class's constructor) is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodeframe.operators.classes import ROOT, matches_class, matches_descriptor, matches_member, parse_target
from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key
from lodeframe.sources.bytecode import FIELDS
from lodeframe.sources.classfile import OBJECT

#: What a usage is: a class, a call or an access.
CLASS, CALL, ACCESS = "CLASS_REFERENCE", "METHOD_CALL", "FIELD_ACCESS"
#: Separates the parts of a key; no name holds it.
SEP = "\x01"


def usage_rows(parsed: DataFrame, instructions: DataFrame) -> DataFrame:
    """(path, line, type, text, rule, owner, name, descriptor): all places of class files that a search may find.

    Headers are on line 1. ``rule`` is what has to match: the class ``owner``, the ``member`` (or its owner), or the ``descriptor``.
    """
    none = F.lit(None).cast("string")

    def of(df: DataFrame, kind, text, rule: str, owner=none, name=none, descriptor=none, line=F.lit(1)) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(F.col("full_path").alias("path"), line.cast("int").alias("line"), kind.alias("type"), text.alias("text"), F.lit(rule).alias("rule"), owner.alias("owner"), name.alias("name"), descriptor.alias("descriptor"))

    ok = parsed.where("error is null")
    up = ok.where("superclass is not null")
    down = ok.select("full_path", F.explode("interfaces").alias("face"))
    fields = ok.select("full_path", F.explode("fields").alias("m"))
    methods = ok.select("full_path", F.explode("methods").alias("m"))
    own, member = F.col("owner"), (F.col("owner"), F.col("name"), F.col("descriptor"))
    dotted = F.concat("op", F.lit(" "), "owner", F.lit("."), "name")
    handle = instructions.where("op = 'invokedynamic'").select("full_path", "line", F.explode("handles").alias("h")).select("full_path", "line", "h.*")
    access = F.when(F.col("kind").isin(*FIELDS), ACCESS).otherwise(CALL)
    dynamic = instructions.where("op = 'invokedynamic'").select("full_path", "line", F.explode("types").alias("owner"))
    named = instructions.where("owner is not null AND (kind = 'class' OR op = 'multianewarray')").select("full_path", "line", "owner").unionByName(dynamic)
    line = F.col("line")
    parts = [
        of(up, CLASS, F.concat(F.lit("extends "), "superclass"), "class", F.col("superclass")),
        of(down, CLASS, F.concat(F.lit("implements "), "face"), "class", F.col("face")),
        of(fields, ACCESS, F.concat(F.lit("field "), "m.name", F.lit(" "), "m.descriptor"), "descriptor", name=F.col("m.name"), descriptor=F.col("m.descriptor")),
        of(methods, CALL, F.concat(F.lit("method "), "m.name", "m.descriptor"), "descriptor", name=F.col("m.name"), descriptor=F.col("m.descriptor")),
        of(instructions.where("kind = 'type' AND op <> 'multianewarray'"), CLASS, F.concat("op", F.lit(" "), "owner"), "class", own, line=line),
        of(named, CLASS, F.concat(F.lit("class "), "owner"), "class", own, line=line),
        of(instructions.where("kind = 'field'"), ACCESS, F.concat(dotted, F.lit(" "), "descriptor"), "member", *member, line=line),
        of(instructions.where("kind = 'call'"), CALL, F.concat(dotted, "descriptor"), "member", *member, line=line),
        of(handle, access, F.concat(F.lit("handle "), "owner", F.lit("."), "name", "descriptor"), "member", *member, line=line),
    ]
    return reduce(DataFrame.unionByName, parts)


def search_usages(usages: DataFrame, query: str) -> DataFrame:
    """Distinct (path, line, type, text) of ``usage_rows`` that match ``Class``, ``package.Class`` or ``Class#member``.

    A member is found by its name in the class asked for, and any use of the class is found with it. A query without a
    class, as ``#member``, finds nothing.
    """
    target = parse_target(query)
    if target is None:
        return usages.where(F.lit(False)).select("path", "line", "type", "text")
    owner = matches_class(target, F.col("owner"))
    found = F.when(F.col("rule") == "class", owner).when(F.col("rule") == "member", owner | matches_member(target, F.col("owner"), F.col("name"))).otherwise(matches_descriptor(target, F.col("descriptor")))
    return usages.where(found).select("path", "line", "type", "text").distinct()


def references(instructions: DataFrame, handles: bool = True) -> DataFrame:
    """(src, member, kind, op, owner, name, descriptor) of every use of a field or method in code, with those by ``handles``.

    ``src`` and ``member`` (name and descriptor) are the method that uses; kind is field or call.
    """
    who = (F.col("class_name").alias("src"), F.concat("method", "method_desc").alias("member"))
    direct = instructions.where("kind IN ('field', 'call')").select(*who, "kind", "op", "owner", "name", "descriptor")
    if not handles:
        return direct
    own = instructions.where("op = 'invokedynamic'").select(*who, F.explode("handles").alias("h"))
    kind = F.when(F.col("h.kind").isin(*FIELDS), "field").otherwise("call")
    return direct.unionByName(own.select("src", "member", kind.alias("kind"), F.col("h.kind").alias("op"), "h.owner", "h.name", "h.descriptor"))


def resolve_uses(uses: DataFrame, method_orders: DataFrame, methods: DataFrame, field_orders: DataFrame, fields: DataFrame) -> DataFrame:
    """``uses`` (src, member, kind, owner, name, descriptor, ...) with declared_in and self_call added.

    ``declared_in`` is the first class in the override order of the owner that declares the member, null for what isn't in
    ``methods`` or ``fields`` (owner, name, descriptor). ``self_call`` says whether a method calls itself. All rows stay.
    """
    key = F.concat_ws(SEP, "kind", "owner", "name", "descriptor")
    uses = materialize(uses.withColumn("__key", key), "uses")
    targets = materialize(uses.groupBy("__key", "kind", "owner", "name", "descriptor").agg(F.count("*").alias("__n")), "targets")

    def first(kind: str, orders: DataFrame, members: DataFrame) -> DataFrame:
        asked = targets.where(F.col("kind") == kind).select("__key", "owner", "name", "descriptor")
        # A class without an order of its own may still declare the member itself.
        places = asked.join(orders.select(F.col("name").alias("owner"), "prio", "declares"), "owner", "left").select("__key", F.coalesce("declares", "owner").alias("declares"), F.coalesce("prio", F.lit(0)).alias("prio"), "name", "descriptor")
        known = members.select(F.col("owner").alias("declares"), "name", "descriptor").distinct()
        # Constructors aren't inherited.
        there = places.join(known, ["declares", "name", "descriptor"]).where("name <> '<init>' OR prio = 0")
        return there.groupBy("__key").agg(F.min(F.struct("prio", "declares")).alias("p")).select("__key", F.col("p.declares").alias("declared_in"))

    found = first("call", method_orders, methods).unionByName(first("field", field_orders, fields))
    resolved = materialize(targets.select("__key", "__n").join(found, "__key", "left"), "resolved")
    total = resolved.agg(F.sum("__n")).first()[0] or 0
    out = join_per_key(uses, resolved, "__key", "__n", total).drop("__key")
    itself = (F.col("kind") == "call") & (F.col("declared_in") == F.col("src")) & (F.concat("name", "descriptor") == F.col("member"))
    return out.withColumn("self_call", F.coalesce(itself, F.lit(False)))


def _edges(resolved: DataFrame, where) -> DataFrame:
    return resolved.where(where).select("src", "member", F.col("declared_in").alias("target"), F.concat("name", "descriptor").alias("target_member")).distinct()


def calls(resolved: DataFrame) -> DataFrame:
    """Distinct (src, member, target, target_member): which method calls which; read backwards, the callers of a method."""
    return _edges(resolved, "kind = 'call' AND declared_in IS NOT NULL")


def unresolved_calls(resolved: DataFrame) -> DataFrame:
    """Distinct (src, member, owner, name, descriptor) of calls to methods that are in no table, but for the root class's constructor."""
    root = (F.col("owner") == OBJECT) & (F.col("name") == "<init>") & (F.col("descriptor") == "()V")
    return resolved.where((F.col("kind") == "call") & F.col("declared_in").isNull() & ~root).select("src", "member", "owner", "name", "descriptor").distinct()


def field_users(resolved: DataFrame) -> DataFrame:
    """Distinct (src, member, target, target_member, access): which method reads or writes which field."""
    access = F.when(F.col("op").startswith("put"), "write").otherwise("read")
    used = resolved.where("kind = 'field' AND declared_in IS NOT NULL")
    return used.select("src", "member", F.col("declared_in").alias("target"), F.col("name").alias("target_member"), access.alias("access")).distinct()


def use_counts(edges: DataFrame) -> DataFrame:
    """(target, target_member, n_users, self_use): how many methods use each member, and whether it uses itself."""
    own = (F.col("src") == F.col("target")) & (F.col("member") == F.col("target_member"))
    return edges.groupBy("target", "target_member").agg(F.count_distinct("src", "member").alias("n_users"), F.bool_or(own).alias("self_use"))


def class_uses(resolved: DataFrame, outer: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst, top_src, top_dst): classes that a class's code uses, through members and the types they mention.

    ``outer`` (name, outer, depth) are the enclosing classes, by default none; top_src and top_dst are the outermost ones.
    ``known`` (name) are the classes to report, by default all. A class that uses itself is reported.
    """
    used = resolved.where("declared_in IS NOT NULL")
    mentioned = F.regexp_extract_all("descriptor", F.lit("L([^;]*);"), F.lit(1))
    pairs = used.select("src", F.explode(F.concat(F.array("declared_in"), F.filter(mentioned, lambda t: t != ROOT))).alias("dst")).distinct()
    if known is not None:
        pairs = pairs.join(known.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    if outer is None:
        return pairs.select("src", "dst", F.col("src").alias("top_src"), F.col("dst").alias("top_dst"))
    top = outer.groupBy("name").agg(F.max_by("outer", "depth").alias("top"))
    for c in ("src", "dst"):
        pairs = pairs.join(top.select(F.col("name").alias(c), F.col("top").alias(f"__{c}")), c, "left")
    return pairs.select("src", "dst", F.coalesce("__src", "src").alias("top_src"), F.coalesce("__dst", "dst").alias("top_dst"))


def calls_within(instructions: DataFrame) -> DataFrame:
    """Distinct (class_name, caller, callee) of calls from a class to methods named on itself."""
    own = instructions.where("kind = 'call' AND owner = class_name")
    return own.select("class_name", F.concat("method", "method_desc").alias("caller"), F.concat("name", "descriptor").alias("callee")).distinct()
