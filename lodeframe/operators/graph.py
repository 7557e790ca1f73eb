"""Hierarchy queries over edge tables: closure with depth, ancestors in common, leaves and chains.

Closures are breadth-first and cycle-safe: each round joins the frontier with the edges, drops the pairs already
reached and writes the new ones to the shared folder, so lineage stays flat and a lost executor costs a read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key, with_count

#: Edges that a task joins at once.
EDGES = 1 << 18


def clean_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) without blanks and self-loops."""
    out = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return out.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def closure(edges: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth, is_direct): everything reachable from each root (a table of ``src``; by default all sources).

    A node isn't reported for itself, even on a cycle. Depth is the length of the shortest path.
    """
    edges = materialize(clean_edges(edges), "edges")
    first = edges if roots is None else edges.join(roots.select("src").distinct(), "src", "left_semi")
    parts = [materialize(first.withColumn("depth", F.lit(1)), "frontier")]
    while not parts[-1].isEmpty() and len(parts) != max_depth:
        step = parts[-1].select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").where("src <> dst").select("src", "dst").distinct()
        known = reduce(DataFrame.unionByName, parts).select("src", "dst")
        parts.append(materialize(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(len(parts) + 1)), "frontier"))
    return reduce(DataFrame.unionByName, parts).withColumn("is_direct", F.col("depth") == 1)


def ordered_closure(edges: DataFrame, roots: DataFrame | None = None, breadth: bool = True) -> DataFrame:
    """(src, dst, depth, path): everything reachable from each root over edges (src, dst, pos), in declared order.

    ``path`` is the array of positions that leads there first: breadth-first the least of the shortest ones, depth-first the
    least of all. Sorted by (depth, path), or by path alone, the rows of a root are in the order of a walk that visits the
    edges of a node by position. Edges must hold no cycle; of edges that repeat a pair the first counts. Rounds go over the
    parents of the roots only, and extend only the paths that the round before made better, so a breadth-first closure reads each
    pair once; roots, which are many where few parents are shared, meet what their parents reach in one join at the end.
    """
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.min("pos").cast("long").alias("pos"))
    links = materialize(links, "edges")
    way = F.struct("depth", "path") if breadth else F.struct("path", "depth")
    first = links if roots is None else links.join(roots.select("src").distinct(), "src", "left_semi")
    first = materialize(first.select("src", "dst", F.lit(1).alias("depth"), F.array("pos").alias("path")), "first")
    parents = links.join(first.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    best = materialize(parents.select("src", "dst", F.lit(1).alias("depth"), F.array("pos").alias("path")), "frontier")
    parts, fresh = [best], best
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("dst", "via").join(links.withColumnRenamed("src", "via"), "via").where("src <> dst")
        step = step.select("src", "dst", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("pos")).alias("path"))
        step = step.groupBy("src", "dst").agg(F.min(way).alias("way"))
        known = reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.min(way).alias("old"))
        better = step.join(known, ["src", "dst"], "left").where(F.col("old").isNull() | (F.col("way") < F.col("old")))
        fresh = materialize(better.select("src", "dst", "way.depth", "way.path"), "frontier")
        parts.append(fresh)
    found = reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.min(way).alias("way"))
    found = found.select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("way.depth").alias("more"), F.col("way.path").alias("onward"))
    far = first.withColumnRenamed("dst", "via").join(found, "via").where("src <> to")
    far = far.select("src", F.col("to").alias("dst"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("path", "onward").alias("path"))
    least = first.unionByName(far).groupBy("src", "dst").agg(F.min(way).alias("way"))
    return least.select("src", "dst", "way.depth", "way.path")


def common_ancestors(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance): the nearest ancestor in common of each pair, itself counted; ties by name.

    ``up`` is a closure towards the ancestors.
    """
    # A node's ancestors are one array, so that a pair stays one row and moves twice, to the arrays of both.
    reach = materialize(up.groupBy("src").agg(F.collect_list(F.struct("dst", "depth")).alias("up")), "reach")
    itself = lambda c: F.array(F.struct(F.col(c).alias("dst"), F.lit(0).alias("depth")))
    both = pairs.select("a", "b").distinct()
    for c, up_c in (("a", "x"), ("b", "y")):
        both = both.join(reach.select(F.col("src").alias(c), F.col("up").alias(up_c)), c, "left")
        both = both.withColumn(up_c, F.when(F.col(up_c).isNull(), itself(c)).otherwise(F.concat(itself(c), up_c)))
    way = lambda p, q: F.struct((p["depth"] + q["depth"]).alias("distance"), p["dst"].alias("ancestor"))
    ways = F.flatten(F.transform("x", lambda p: F.transform(F.filter("y", lambda q: q["dst"] == p["dst"]), lambda q: way(p, q))))
    best = both.select("a", "b", F.array_min(ways).alias("m")).where("m IS NOT NULL")
    return best.select("a", "b", "m.ancestor", "m.distance")


def declared_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor) of each distinct pair: itself where both are one, b where a reaches it, else the first ancestor of b, depth-first
    in the order of declarations, that a reaches too; null where there is none.

    ``edges`` are (src, dst, pos) from classes to their parents, without a cycle.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    above = closure(edges, pairs.select(F.col("a").alias("src"))).groupBy(F.col("src").alias("a")).agg(F.collect_list("dst").alias("above"))
    walk = ordered_closure(edges, pairs.select(F.col("b").alias("src")), breadth=False)
    walk = walk.groupBy(F.col("src").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "dst"))), lambda w: w["dst"]).alias("walk"))
    # What is known of a node is one array, so that a pair stays one row.
    both = pairs.join(materialize(above, "above"), "a", "left").join(materialize(walk, "walk"), "b", "left")
    order = F.concat(F.array("b"), F.coalesce("walk", F.array().cast("array<string>")))
    first = F.get(F.filter(order, lambda n: F.array_contains("above", n)), F.lit(0))
    return both.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(first).alias("ancestor"))


def leaves(edges: DataFrame) -> DataFrame:
    """(node): targets that are no source."""
    e = clean_edges(edges)
    return e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")


def children(edges: DataFrame) -> DataFrame:
    """(parent, child, n_children): distinct children, a row each, with the number of their parent's, from edges child -> parent."""
    e = clean_edges(edges).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return with_count(e, "parent", "n_children")


def assignable_to(members: DataFrame, name: str, edges: DataFrame, target) -> DataFrame:
    """``members`` whose ``name`` is the target or reaches it over child -> parent edges."""
    turned = clean_edges(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = members.sparkSession.createDataFrame([(target,)], turned.select("src").schema)
    below = closure(turned, roots).select(F.col("dst").alias(name)).unionByName(roots.select(F.col("src").alias(name)))
    return members.join(below, name, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a, b) that reach a smaller one: component is the smallest of them.

    Self-loops are left out, and so are edges with a null end. Nodes are longs (``_long_components``), or of any other type that has an order.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    return _long_components(edges) if {kind for _, kind in edges.dtypes} == {"bigint"} else _any_components(edges)


def _any_components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds, a logarithmic number in practice; each round is a table in the
    shared folder, and the end is noticed by the number and the hash of all edges, one row."""
    edges = materialize(edges.distinct(), "edges")
    seen = None
    while True:
        both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        large = materialize(_star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = _star(large)
        edges = materialize(low.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(large.groupBy("a").agg(F.min("b").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now


def _long_components(edges: DataFrame) -> DataFrame:
    """Rounds of two tables each: edges that tasks have joined to stars, and the nodes whose place is open.

    Tasks join what they read before it is dealt by the larger end, and what they get after; so a node has at most one row a
    task, and all its rows meet. Then whatever hangs on a node that itself hangs on another is hung there. It ends when no node has
    both or has two rows, so that there is no round which only finds that nothing changed.
    """
    while True:
        stars = materialize(_joined(_joined(edges).repartition("a").sortWithinPartitions("a")), "stars")
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("m")), F.struct(F.col("b").alias("u"), F.lit(None).cast("long").alias("m")))
        found = stars.select(F.explode(ends).alias("e")).groupBy("e.u").agg(F.min("e.m").alias("m"), F.count("e.m").alias("up"), F.count_if(F.col("e.m").isNull()).alias("n"))
        inner = materialize(found.where("up > 1 OR up > 0 AND n > 0"), "inner")
        nodes, total = inner.agg(F.count("*"), F.sum("n")).first()
        if not nodes:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = stars
        if total:
            hung = join_per_key(stars.withColumnRenamed("b", "u"), inner.where("n > 0").select("u", "m", "n"), "u", "n", total, "left")
            edges = hung.select("a", F.coalesce("m", "u").alias("b"))


def _joined(edges: DataFrame) -> DataFrame:
    """(a, b): stars, b the smallest node, that join the same nodes as long ``edges`` (a, b), about ``EDGES`` of a task at once.

    Where edges are sorted by a, all of one a are joined at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in ((0, a), (1, b)))
            if len(a) >= EDGES:
                # The last node may have more rows.
                last = a == a[-1]
                yield _stars(a[~last], b[~last])
                a, b = a[last], b[last]
        yield _stars(a, b)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of the edges (a, b) but the smallest of its component, with the smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    hung = np.flatnonzero(low != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[low[hung]])], names=["a", "b"])


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair (a, b) as u and v, with the smallest of u and all its partners."""
    mins = materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "mins")
    total = mins.agg(F.sum("n")).first()[0] or 0
    return join_per_key(pairs, mins, "a", "n", total).select(F.col("a").alias("u"), F.col("b").alias("v"), "m")
