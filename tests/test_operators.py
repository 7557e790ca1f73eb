"""Operators on small literal fixtures: cycles, diamonds, nulls, empties."""

from pyspark.sql import functions as F

from lodeframe.functions import predicates as P
from lodeframe.operators import graph, relations, search
from lodeframe.operators.lines import lines

CLASSES = [("com/example/Service", 0x201, None), ("com/example/Repository", 0x201, None), ("com/example/Component", 0x2001, None), ("com/example/Color", 0x4001, None),
           ("com/example/ServiceImpl", 1, None), ("com/example/RepoImpl", 1, None), ("com/example/AnnotatedClass", 1, None), ("com/example/Child", 1, "com/example/ServiceImpl"),
           ("com/example/RealAnnotation", 0x2601, None)]


def names(df, *columns):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect())


def test_kinds_and_statistics(spark):
    df = spark.createDataFrame(CLASSES, "name string, modifiers int, superclass string")
    m = F.col("modifiers")
    row = relations.statistics(df, interfaces=P.has_bits(m, P.INTERFACE), annotations=P.has_bits(m, P.ANNOTATION), enums=P.has_bits(m, P.ENUM), standard=P.is_standard(m)).first()
    assert tuple(row) == (9, 3, 2, 1, 4)
    assert names(relations.group_by_package(df, "name"), "package", "n") == [("com/example", 9)]
    assert names(df.where("superclass = 'com/example/ServiceImpl'"), "name") == ["com/example/Child"]


def test_closure_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")], "src string, dst string")
    found = names(graph.closure(edges), "src", "dst", "depth", "is_direct")
    assert found == [("b", "a", 1, True), ("c", "a", 1, True), ("d", "a", 2, False), ("d", "b", 1, True), ("d", "c", 1, True), ("x", "y", 1, True), ("y", "x", 1, True)]
    assert names(graph.closure(edges.where("src = 'none'")), "src") == []
    assert names(graph.leaves(edges), "node") == ["a"]
    pairs = spark.createDataFrame([("b", "c"), ("d", "b"), ("b", "x")], "a string, b string")
    assert names(graph.common_ancestors(graph.closure(edges), pairs), "a", "b", "ancestor", "distance") == [("b", "c", "a", 2), ("d", "b", "b", 1)]


def test_set_algebra_keeps_direct_apart(spark):
    a = spark.createDataFrame([("p", True), ("q", False), ("q", True)], "name string, is_direct boolean")
    b = spark.createDataFrame([("q", False), ("r", True)], "name string, is_direct boolean")
    assert names(relations.union(a, b), "name", "is_direct") == [("p", True), ("q", True), ("r", True)]
    assert names(relations.intersect(a, b), "name", "is_direct") == [("q", False)]
    assert names(relations.exclude(a, b), "name", "is_direct") == [("p", True)]


def test_glob_dialects(spark):
    df = spark.createDataFrame([("a/b/App.class",), ("a/internal/Hidden.class",), ("FooGenerated.class",)], "p string")
    p = F.col("p")
    assert names(df.where(P.path_glob(p, "a/*.class")), "p") == []
    assert names(df.where(P.path_glob(p, "a/**.class")), "p") == ["a/b/App.class", "a/internal/Hidden.class"]
    assert names(df.where(~P.contains_glob(p, "*/INTERNAL/*") & ~P.contains_glob(p, "*generated.class")), "p") == ["a/b/App.class"]
    assert names(df.where(P.accepted(p, [], ["Foo*"], P.simple_glob)), "p") == ["a/b/App.class", "a/internal/Hidden.class"]


def test_descriptors_and_names(spark):
    df = spark.createDataFrame([("(I[Ljava/lang/String;J)V",)], "d string")
    assert df.select(F.transform(P.parameter_types(F.col("d")), P.type_name)).first()[0] == ["int", "java.lang.String[]", "long"]
    row = spark.range(1).select(P.package_of(F.lit("/X")), P.package_of(F.lit("a/b/X")), P.extension(F.lit("a.b/C.TXT")), P.extension(F.lit("a.b/C")), P.simple_name(F.lit("a/B$C")), P.modifier_text(F.lit(0x409))).first()
    assert tuple(row) == ("", "a/b", "txt", "", "C", "public static abstract")


def test_lines_and_search(spark):
    docs = spark.createDataFrame([(1, "one\r\ntwo x\n\n"), (2, ""), (3, None), (4, "// x y\r[x")], "id int, t string")
    assert names(lines(docs, "id", "t"), "full_path", "line_no", "line") == [("1", 1, "one"), ("1", 2, "two x"), ("2", 1, ""), ("4", 1, "// x y"), ("4", 2, "[x")]
    hit = lambda **o: names(search.text_hits(docs, "id", "t", **o), "full_path", "line_number")
    assert hit(query="X", whole_word=True) == [("1", 2), ("4", 1), ("4", 2)]
    assert hit(query="[x", regex=True) == [] and hit(query="") == [] and hit(query="X", case_sensitive=True) == []
    hits = spark.createDataFrame([(f"C{i}.class", i + 1, "m", "CODE_TEXT", 3) for i in range(20)], search.HIT)
    assert search.merge_hits([hits], 7).count() == 7
    assert names(lines(docs, "id", "t").where(P.is_comment_line(F.col("line"))), "line") == ["// x y"]


def test_regions_and_nearest(spark):
    regions = spark.createDataFrame([("r1", 0, 100), ("r2", 10, 5), ("r3", 10, 0)], "region string, start long, length long")
    points = spark.createDataFrame([(12,), (15,), (100,)], "point long")
    assert names(relations.enclosing_regions(points, regions, 8), "point", "region") == [(12, "r1"), (12, "r2"), (15, "r1")]
    queries = spark.createDataFrame([("k", 5), ("k", 1), ("j", 9)], "k string, at int")
    marks = spark.createDataFrame([("k", 2, "m2"), ("k", 5, "m5")], "k string, at int, v string")
    found = relations.nearest_before(queries, marks, "k", "at", "v")
    assert sorted(map(str, found.select("k", "at", "v").collect())) == sorted(map(str, spark.createDataFrame([("k", 5, "m5"), ("k", 1, None), ("j", 9, None)], "k string, at int, v string").collect()))


def test_nearest_before_over_ranges(spark):
    rows = [(k, at, i) for i, (k, at) in enumerate((k, at) for k in ("hot", "hot", None, "x") for at in (None, -7, 0, 3, 8, 9, 40, 41))]
    queries = spark.createDataFrame([r for r in rows if r[2] % 3], "k string, at long, id int")
    marks = spark.createDataFrame([(k, at, None if i % 9 == 0 else i) for k, at, i in rows if i % 3 == 0], "k string, at long, v int")
    want = []
    for k, at, i in rows:
        if i % 3:
            place = lambda x: (x is not None, x or 0)
            own = [(place(b), j) for c, b, j in rows if j % 3 == 0 and j % 9 and c == k and place(b) <= place(at)]
            want.append((i, max(own)[1] if own else None))
    for chunk in (1, 8, 1000):
        found = relations.nearest_before(queries, marks, "k", "at", "v", chunk)
        assert sorted(tuple(r) for r in found.select("id", "v").collect()) == sorted(want)


def test_regions_of_any_length(spark):
    regions = [(i, start, length) for i, (start, length) in enumerate([(-5, 1), (-5, 12), (0, 10**15), (-(10**17), 10**17 + 1), (7, 8), (7, 9), (2**60, 2**61)])]
    points = [(-5,), (0,), (6,), (7,), (14,), (15,), (10**15 - 1,), (10**15,), (2**60 + 5,), (-(10**17),)]
    found = relations.enclosing_regions(spark.createDataFrame(points, "point long"), spark.createDataFrame(regions, "region int, start long, length long"), 8)
    assert names(found, "point", "region") == sorted((p, r) for (p,) in points for r, s, n in regions if s <= p < s + n)


def test_running_trim_over_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 4)
    rows = [(i * i * 977 - 5000, i % 7) for i in range(200)]
    run, want = 0, []
    for at, size in sorted(rows, reverse=True):
        run += size
        want += [at] if run <= 333 else []
    assert names(search.running_trim(spark.createDataFrame(rows, "id long, n long"), "id", "n", 333, 50), "id") == sorted(want)


def test_children_and_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "a"), ("d", "b"), ("a", "a"), ("x", "y"), (None, "y")], "src string, dst string")
    assert names(graph.children(edges), "parent", "child", "n_children") == [("a", "b", 2), ("a", "c", 2), ("b", "d", 1), ("y", "x", 1)]
    assert names(relations.dependencies(edges, "src", "dst"), "name", "uses", "n") == [("b", "a", 1), ("c", "a", 1), ("d", "b", 1), ("x", "y", 1)]
    found = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert names(found.where("node <> component"), "node", "component") == [("b", "a"), ("c", "a"), ("d", "a"), ("y", "x")]


def test_a_pair_stays_one_row_while_ancestors_are_met(spark):
    """Pairs are not multiplied by the ancestors of their sides."""
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "q"), ("q", "r"), ("z", "y")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z"), ("r", "a"), ("x", "x"), ("a", None)], "a string, b string")
    found = graph.common_ancestors(graph.closure(edges), pairs)
    assert names(found, "a", "b", "ancestor", "distance") == [("a", "b", "p", 2), ("r", "a", "r", 3), ("x", "x", "x", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Aggregate") == 1
