"""Components of longs against brute force, and how many tables they take."""

import numpy as np
import pytest

from lodeframe.operators import graph
from lodeframe.plans import scratch


def brute(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(int(a)), root(int(b))
        parent[max(x, y)] = min(x, y)
    return sorted((int(x), int(root(x))) for x in parent if root(x) != x)


def found(spark, pairs, parts=8):
    """Components, and how many tables were written."""
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(parts)
    before = len(scratch.written(spark))
    rows = graph.components(df).collect()
    return sorted((r["node"], r["component"]) for r in rows), len(scratch.written(spark)) - before


def shuffled(pairs, nodes, seed=5):
    """``pairs`` under other, signed names."""
    names = np.random.default_rng(seed).permutation(np.arange(nodes) - nodes // 2) * 1_000_003
    return [(int(names[a]), int(names[b])) for a, b in pairs]


GRAPHS = {
    "path": shuffled([(i, i + 1) for i in range(4000)], 4001),
    "star": [(i, 0) for i in range(1, 3000)],
    "hub with the largest name": [(10_000, i) for i in range(3000)],
    "caterpillar": shuffled([(i, i + 1) for i in range(300)] + [(i % 300, 301 + i) for i in range(3000)], 3301),
    "sparse": [tuple(x) for x in np.random.default_rng(1).integers(-2000, 2000, (2200, 2))],
}


@pytest.mark.parametrize("edges", [16, 1 << 18])
@pytest.mark.parametrize("name", GRAPHS)
def test_components_of_longs(spark, monkeypatch, name, edges):
    monkeypatch.setattr(graph, "EDGES", edges)
    got, tables = found(spark, GRAPHS[name])
    assert got == brute(GRAPHS[name])
    if edges > 16:
        assert tables <= 10


def test_a_star_takes_two_tables(spark):
    """Rounds cost the driver memory; here the first one is the last."""
    got, tables = found(spark, GRAPHS["star"])
    assert got == [(i, 0) for i in range(1, 3000)] and tables == 2


def test_no_edges_repeats_and_loops(spark):
    assert found(spark, []) == ([], 2)
    assert found(spark, [(5, 5), (7, 3), (3, 7), (7, 3)])[0] == [(7, 3)]
    odd = spark.createDataFrame([(None, 4), (4, None), (None, None), (2, 9)], "a long, b long")
    assert [tuple(r) for r in graph.components(odd).collect()] == [(9, 2)]


def test_stars_in_parts_keep_all_rows_of_a_node_together(spark, monkeypatch):
    """However small the parts, a node with several rows is joined once."""
    monkeypatch.setattr(graph, "EDGES", 4)
    df = spark.createDataFrame([(9, i) for i in range(7)] + [(12, i) for i in range(7, 9)], "a long, b long").coalesce(1).sortWithinPartitions("a")
    rows = sorted(tuple(r) for r in graph._joined(df).collect())
    assert rows == [*((i, 0) for i in range(1, 7)), (8, 7), (9, 0), (12, 7)]
