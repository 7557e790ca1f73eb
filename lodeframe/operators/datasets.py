"""Keyed datasets (renames, comments), mapping files, directory trees, graph texts and layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeframe.operators.graph import clean_edges
from lodeframe.plans.scratch import materialize


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; an aggregate, so tasks merge versions before they shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], skip_existing: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``, which replace those of the same keys, or give way to them with ``skip_existing``.

    Null keys equal each other. Each input has its keys once.
    """
    first, second = (old, new) if skip_existing else (new, old)
    has = first.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return first.unionByName(second.join(has, same, "left_anti"))


def parse_mapping(lines: DataFrame) -> DataFrame:
    """Renames (full_path, line_no, type, class_name, old_name, new_name, desc) of mapping files given as lines.

    ``original -> obfuscated:`` opens a class, ``type name -> obfuscated`` and ``type name(types) -> obfuscated`` are its
    members, with or without leading line numbers. A member belongs to the nearest class line above it in its file;
    one without is left out, as are blank and ``#`` lines. desc is the declaration's types.
    """
    body = F.regexp_replace("line", r"^\s+|\s+$", "")
    header, member = r"^(\S+)\s+->\s+(\S+):$", r"^(?:\d+:\d+:)?(\S+)\s+([^\s(:]+)(\([^)]*\))?(?::\d+(?::\d+)?)?\s+->\s+(\S+)$"
    rows = lines.withColumn("b", body).where((F.col("b") != "") & ~F.col("b").startswith("#"))
    rows = rows.withColumn("own", F.when(F.col("b").rlike(header), F.translate(F.regexp_extract("b", header, 2), ".", "/")))
    above = Window.partitionBy("full_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("class_name", F.last("own", ignorenulls=True).over(above)).where(F.col("class_name").isNotNull())
    cut = lambda c: F.regexp_extract(c, r"([^/.$]*)$", 1)
    is_class, part = F.col("own").isNotNull(), lambda i: F.regexp_extract("b", member, i)
    rows = rows.where(is_class | F.col("b").rlike(member))
    return rows.select(
        "full_path", "line_no",
        F.when(is_class, "CLASS").when(part(3) != "", "METHOD").otherwise("FIELD").alias("type"), "class_name",
        F.when(is_class, cut("own")).otherwise(part(4)).alias("old_name"),
        F.when(is_class, cut(F.regexp_extract("b", header, 1))).otherwise(part(2)).alias("new_name"),
        F.when(is_class, "").otherwise(F.concat(part(1), part(3))).alias("desc"),
    )


def mapping_text(renames: DataFrame) -> DataFrame:
    """(class_name, text): the mapping block of each class, its members by type and name; the inverse of ``parse_mapping``."""
    dotted = lambda c: F.translate(c, "/", ".")
    types, args = F.regexp_extract("desc", r"^([^(]*)", 1), F.regexp_extract("desc", r"(\(.*)$", 1)
    line = F.when(F.col("type") != "CLASS", F.concat(F.lit("    "), types, F.lit(" "), "new_name", args, F.lit(" -> "), "old_name"))
    new = F.max(F.when(F.col("type") == "CLASS", F.concat(F.regexp_replace("class_name", r"[^/$]*$", ""), "new_name")))
    per_class = renames.groupBy("class_name").agg(new.alias("new"), F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("type", "old_name", line.alias("line"))))).alias("m"))
    head = F.concat(dotted(F.coalesce("new", "class_name")), F.lit(" -> "), dotted(F.col("class_name")), F.lit(":"))
    return per_class.select("class_name", F.concat_ws("\n", head, F.transform("m", lambda x: x["line"])).alias("text"))


def apply_renames(text: Column, names: Column) -> Column:
    """``text`` with each whole identifier (ASCII letters, digits, ``_`` and ``$``) that is a key of the map ``names`` replaced."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_$]+|[^A-Za-z0-9_$]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(names, p), p)), "")


def directory_tree(df: DataFrame, path: str) -> DataFrame:
    """(path, parent_path, name, depth, is_leaf): every directory and entry of the paths, once.

    Both ``/`` and ``:`` separate levels, empty levels are left out; a level that another path continues is no leaf.
    """
    levels = F.filter(F.split(F.col(path), "[/:]"), lambda x: x != "")
    rows = df.select(levels.alias("l")).where(F.size("l") > 0).distinct()
    nodes = rows.select("l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("depth"))
    joined = lambda n: F.array_join(F.slice("l", 1, n), "/")
    return nodes.groupBy(joined(F.col("depth")).alias("path")).agg(
        F.min(joined(F.col("depth") - 1)).alias("parent_path"), F.min(F.get("l", F.col("depth") - 1)).alias("name"),
        F.min("depth").alias("depth"), F.min(F.col("depth") == F.size("l")).alias("is_leaf"),
    )


def dot_text(edges: DataFrame, most: int, name: str = "graph") -> DataFrame:
    """One row (dot): a digraph of the first ``most`` edges by name. The limit is the graph's own: a text isn't distributed."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    top = clean_edges(edges).orderBy("src", "dst").limit(most)
    line = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";"))
    body = top.agg(F.sort_array(F.collect_list(F.struct("src", "dst", line.alias("line")))).alias("e"))
    return body.select(F.concat_ws("\n", F.lit(f'digraph "{name}" {{'), F.transform("e", lambda x: x["line"]), F.lit("}")).alias("dot"))


def parse_dot(df: DataFrame, text: str) -> DataFrame:
    """(src, dst) of the edges in DOT texts with quoted or plain names."""
    name = r'("(?:[^"\\]|\\.)*"|[A-Za-z0-9_.]+)'
    pattern = rf"{name}\s*->\s*{name}"
    plain = lambda i: F.replace(F.regexp_replace(F.regexp_extract("e", pattern, i), '^"|"$', ""), F.lit('\\"'), F.lit('"'))
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("e")).select(plain(1).alias("src"), plain(2).alias("dst"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): sources are 0, others one below their deepest predecessor; nodes on or behind cycles share the last layer.

    Each round takes the nodes that no remaining edge enters; the remaining edges are written, so lineage stays flat.
    """
    left = materialize(clean_edges(edges), "layers")
    every = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    done, n = [], 0
    rest = materialize(every, "nodes")
    while not rest.isEmpty():
        free = rest.join(left.select(F.col("dst").alias("node")), "node", "left_anti")
        free = materialize(free.withColumn("layer", F.lit(n)), "layer")
        if free.isEmpty():
            done.append(rest.withColumn("layer", F.lit(n)))
            break
        done.append(free)
        rest = materialize(rest.join(free, "node", "left_anti"), "nodes")
        left = materialize(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "layers")
        n += 1
    return reduce(DataFrame.unionByName, done) if done else every.withColumn("layer", F.lit(0))
