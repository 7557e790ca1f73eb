"""Names, descriptors, trees, renames and byte search on small fixtures."""

from pyspark.sql import functions as F

from lodeframe.functions import names as N
from lodeframe.operators import overrides, renames, search, trees


def table_of(df, *columns):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect())


def test_paths_and_versions(spark):
    row = spark.range(1).select(N.normalize_path(F.lit("//a/b/")), N.path_to_package(F.lit("a/b")), N.package_to_path(F.lit("a.b")), N.class_file_path(F.lit("a.b.C")), N.java_version(F.lit(61)), N.java_version(F.lit(3))).first()
    assert tuple(row) == ("a/b", "a.b", "a/b", "a/b/C.class", 17, 3)


def test_names(spark):
    words = ["a", "id", "ID", "abcd", "a-", "", None, "if", "_", "x$1", "1a", "é", "漢", "a b", "   ", "a\n", "\U0001D400"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    pick = lambda c: [r[0] for r in df.where(c).collect()]
    assert pick(N.is_obfuscated(F.col("n"))) == ["a", "if", "_", "x$1", "1a", "é", "漢"]
    assert pick(N.is_valid_name(F.col("n"))) == ["a", "id", "ID", "abcd", "x$1", "é", "漢", "\U0001D400"]
    assert pick(N.is_printable_ascii(F.col("n"))) == ["a", "id", "ID", "abcd", "a-", "if", "_", "x$1", "1a", "a b"]
    assert not {"id", "ID", "abcd"} & set(pick(N.is_poor_name(F.col("n"))))


def test_descriptors(spark):
    rows = [("()V", 0, "V"), ("(I[[JLa/B;)La/C;", 3, "a/C"), ("(La/B)V", -1, "V"), (None, -1, "V"), ("", -1, "V"), ("I", -1, "V"), ("([)I", 1, "I"), ("(Q)I", 1, "I")]
    df = spark.createDataFrame([(d,) for d, _, _ in rows], "d string")
    found = df.select(N.parameter_count(F.col("d")), N.return_type(F.col("d"))).collect()
    assert [tuple(r) for r in found] == [(n, t) for _, n, t in rows]
    fits = [tuple(r) for r in df.select(*(N.has_parameter_count(F.col("d"), n) for n in (0, 1, 3))).collect()]
    assert fits == [(True, False, False), (False, False, True), (False, False, False), (True, False, False), (True, False, False), (True, False, False), (False, True, False), (False, False, False)]


def test_forest_and_preorder(spark):
    rows = [(0, "a", None), (1, "b", "a"), (2, "c", "b"), (3, "d", "a"), (4, "e", "gone"), (5, "b", "e"), (6, "f", "b"), (7, "x", "y"), (8, "y", "x"), (9, None, "c")]
    nodes = spark.createDataFrame(rows, "at long, id string, up string")
    found = trees.preorder(nodes, "id", "up", "at").orderBy("place").select("place", "at", "depth").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 9, 3), (4, 6, 2), (5, 3, 1), (6, 4, 0), (7, 5, 1)]
    assert table_of(trees.forest(nodes, "id", "up", "at").where("parent_order IS NULL"), "id") == ["a", "e"]
    assert trees.preorder(nodes.where("false"), "id", "up", "at").count() == 0


def test_places(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5000).alias("v"))
    assert all(r.v == r.place for r in trees.ranked(df, ["v"], "place").collect())


def test_class_renames(spark):
    names = ["a/b/Main", "a/b/c", "a/b/Main$1", "a/b/Main$x", "lib/Big/Large", "lib/Big", "java/q/a", "a/R", "a/R$id", "a/BuildConfig", "a/Wörter", None]
    found = renames.class_renames(spark.createDataFrame([(n,) for n in names], "name string"))
    assert table_of(found, "class_name", "old_name", "new_name") == [
        ("a/Wörter", "Wörter", "C0000Wrter"), ("a/b/Main$x", "x", "C0001x"), ("a/b/c", "c", "C0002c"), ("lib/Big", "Big", "C0003Big"),
    ]


def test_member_renames(spark):
    fields = spark.createDataFrame([("k/A", 0, "a", "I"), ("k/A", 1, "count", "I"), ("k/A", 2, "same", "I"), ("k/A", 3, "same", "J"), ("k/A", 4, "f0a", "I"), ("java/A", 0, "a", "I")], "owner string, pos int, name string, descriptor string")
    methods = spark.createDataFrame([("k/A", 0, "<init>", "()V"), ("k/A", 1, "b", "()V"), ("k/A", 2, "on", "()V"), ("k/A", 3, "dup", "()V"), ("k/A", 4, "dup", "()V"), ("k/A", 5, "main", "()V"), ("k/B", 0, "run", "()V")], fields.schema)
    found = renames.member_renames(fields, methods)
    assert table_of(found, "owner", "is_method", "name", "descriptor", "new_name") == [
        ("k/A", False, "a", "I", "f0a_2"), ("k/A", False, "f0a", "I", "f3f0a"), ("k/A", False, "same", "I", "f1same"), ("k/A", False, "same", "J", "f2same"),
        ("k/A", True, "b", "()V", "m0b"), ("k/A", True, "dup", "()V", "m2dup"), ("k/A", True, "on", "()V", "mo1on"), ("k/B", True, "run", "()V", "mo4run"),
    ]


def test_byte_search(spark):
    assert search.hex_bytes("0x CA_fe") == b"" and search.hex_bytes("CA fe-00") == b"\xca\xfe\x00" and search.hex_bytes("") == b""
    df = spark.createDataFrame([("p", bytearray(b"aaaa\0a")), ("q", bytearray(b"")), ("r", None)], "path string, content binary")
    assert table_of(search.byte_hits(df, "path", "content", b"aa"), "full_path", "offset") == [("p", 0), ("p", 1), ("p", 2)]
    assert search.byte_hits(df, "path", "content", b"").count() == 0
    assert table_of(search.quick_open(df, "path", "P"), "path") == ["p"] and search.quick_open(df, "path", "").count() == 3


def test_families(spark):
    found = spark.createDataFrame([("c", "f", "()V", "b"), ("b", "f", "()V", "a"), ("d", "f", "()V", "a"), ("d", "g", "()V", "a")], "owner string, name string, descriptor string, base string")
    assert table_of(overrides.families(found), "owner", "name", "family") == [("a", "f", "a.f()V"), ("a", "g", "a.g()V"), ("b", "f", "a.f()V"), ("c", "f", "a.f()V"), ("d", "f", "a.f()V"), ("d", "g", "a.g()V")]
