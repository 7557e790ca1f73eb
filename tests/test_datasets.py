"""Keyed datasets, mapping files, graph texts, override relations and the class report on small fixtures."""

from pyspark.sql import functions as F

from lodeframe.operators import datasets, overrides
from lodeframe.operators.lines import lines

MAPPING = """# head
lost int x -> a
com.example.User -> a.b$c:
    int count -> a
    1:3:void run(int,java.lang.String):4:5 -> b

com.example.Other -> d:
    long size -> a
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_mapping_round_trip(spark):
    df = spark.createDataFrame([("m.txt", MAPPING)], "path string, text string")
    renames = datasets.parse_mapping(lines(df, "path", "text")).drop("full_path", "line_no")
    want = [
        ("CLASS", "a/b$c", "c", "User", ""), ("CLASS", "d", "d", "Other", ""), ("FIELD", "a/b$c", "a", "count", "int"),
        ("FIELD", "d", "a", "size", "long"), ("METHOD", "a/b$c", "b", "run", "void(int,java.lang.String)"),
    ]
    assert rows(renames) == want
    text = {r.class_name: r.text for r in datasets.mapping_text(renames).collect()}
    assert text["d"] == "Other -> d:\n    long size -> a"
    again = datasets.parse_mapping(lines(spark.createDataFrame(list(text.items()), "path string, text string"), "path", "text"))
    assert rows(again.drop("full_path", "line_no")) == want


def test_keyed(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "m"), (2, "c"), (3, "d")], "k int, v string")
    assert rows(datasets.upsert(old, new, ["k"])) == sorted([(1, "a"), (None, "m"), (2, "c"), (3, "d")], key=str)
    assert rows(datasets.upsert(old, new, ["k"], True)) == sorted([(1, "a"), (None, "n"), (2, "b"), (3, "d")], key=str)
    both = old.withColumn("t", F.lit(1)).union(new.withColumn("t", F.lit(2)))
    assert rows(datasets.latest_wins(both, ["k"], ["t"]).select("k", "v")) == sorted([(1, "a"), (None, "m"), (2, "c"), (3, "d")], key=str)


def test_renamed_text(spark):
    df = spark.createDataFrame([("foo foobar $foo foo.x",), ("",), (None,)], "t string")
    names = F.create_map(F.lit("foo"), F.lit("y$1"))
    assert [r[0] for r in df.select(datasets.apply_renames(F.col("t"), names)).collect()] == ["y$1 foobar $foo y$1.x", "", None]


def test_dot_round_trip(spark):
    edges = spark.createDataFrame([('a"q', "b"), ("b", "c"), ("b", "b"), (None, "c")], "src string, dst string")
    dot = datasets.dot_text(edges, 10)
    assert rows(datasets.parse_dot(dot, "dot")) == [('a"q', "b"), ("b", "c")]
    assert datasets.dot_text(edges.where("false"), 10).first()[0] == 'digraph "graph" {\n}'


def test_layers_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert rows(datasets.layers(edges)) == [("a", 0), ("b", 1), ("c", 2), ("x", 3), ("y", 3), ("z", 3)]
    assert datasets.layers(edges.where("false")).count() == 0


def test_tree(spark):
    df = spark.createDataFrame([("a.jar:p/X",), ("a.jar:p/X/y",), ("/",), (None,)], "p string")
    assert rows(datasets.directory_tree(df, "p")) == [
        ("a.jar", "", "a.jar", 1, False), ("a.jar/p", "a.jar", "p", 2, False), ("a.jar/p/X", "a.jar/p", "X", 3, False), ("a.jar/p/X/y", "a.jar/p/X", "y", 4, True),
    ]


def test_class_report(spark):
    edges = spark.createDataFrame([
        ("implements", "Impl", "Service"), ("extends", "Impl", "Base"), ("extends", "Sub", "Impl"), ("extends", "Base", "java/util/ArrayList"), ("annotated", "Impl", "Mark"),
    ], "rel string, src string, dst string")
    methods = spark.createDataFrame([
        ("Service", "save", "()V", 1), ("Impl", "save", "()V", 1), ("Sub", "save", "()V", 1), ("Base", "open", "()V", 1), ("Base", "hidden", "()V", 2), ("java/util/ArrayList", "save", "()V", 1), ("Impl", "<init>", "()V", 1),
    ], "owner string, name string, descriptor string, modifiers int")
    assert rows(overrides.overrides(methods, edges)) == [("Impl", "save", "()V", "Service"), ("Sub", "save", "()V", "Impl")]
    roots = spark.createDataFrame([("Impl",), ("Service",), ("Mark",)], "name string")
    assert {(r.root, r.kind, r.item) for r in overrides.class_report(roots, methods, edges).collect()} == {
        ("Impl", "SUPER_CLASS", "Base"), ("Impl", "INTERFACE", "Service"), ("Impl", "ANNOTATION", "Mark"), ("Impl", "OVERRIDES", "Service.save()V"),
        ("Impl", "OVERRIDDEN_BY", "Sub.save()V"), ("Impl", "INHERITED", "Base.open()V"), ("Impl", "SUBCLASS", "Sub"),
        ("Service", "OVERRIDDEN_BY", "Impl.save()V"), ("Service", "OVERRIDDEN_BY", "Sub.save()V"), ("Service", "IMPLEMENTATION", "Impl"), ("Service", "IMPLEMENTATION", "Sub"),
        ("Mark", "ANNOTATED", "Impl"),
    }
