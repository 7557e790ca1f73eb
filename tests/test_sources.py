"""Archives and class files: jars of the installed Spark against Python's own listing, and malformed input."""

import datetime
import glob
import io
import os
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from lodeframe.sources import archives, classfile, sinks

NOW = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)


def small_jar():
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar"))
    return min((j for j in jars if any(n.endswith(".class") for n in zipfile.ZipFile(j).namelist()) and os.path.getsize(j) > 60_000), key=os.path.getsize)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c), NOW, i) for i, (p, c) in enumerate(rows)], "path string, content binary, mtime timestamp, classpath_idx int")


def test_jar_of_classes(spark):
    jar = small_jar()
    entries = archives.read_entries(spark, [jar]).where("node_type = 'CLASS_FILE'")
    names = [n for n in zipfile.ZipFile(jar).namelist() if n.endswith(".class")]
    assert sorted(r.path for r in entries.select("path").collect()) == sorted(names)
    parsed = classfile.parse_classes(archives.mask_duplicates(entries)).cache()
    assert classfile.rejected(parsed).count() == 0
    known = {r.name: r for r in classfile.classes(parsed).collect()}
    own = {n[:-6] for n in names if not n.endswith("module-info.class") and not n.startswith("META-INF/")}
    assert own <= {n for n, r in known.items() if not r.is_external}
    up = classfile.edges(parsed).where("rel IN ('extends', 'implements')").select("dst").distinct().collect()
    assert {r.dst for r in up} <= set(known)
    methods = classfile.methods(parsed)
    assert methods.where("name = '<init>' AND has_body").count() > 0
    assert methods.where(~F.col("descriptor").rlike(r"^\(.*\).+$")).count() == 0
    assert classfile.fields(parsed).where("descriptor = ''").count() == 0
    assert classfile.edges(parsed).where("src = dst AND rel = 'references'").count() == 0
    assert classfile.annotations(parsed).where("annotation is null").count() == 0
    parsed.unpersist()


def test_malformed_classes_have_no_row(spark):
    bad = spark.createDataFrame([("null", None), ("empty", b""), ("zeros", bytes(64)), ("magic", b"\xca\xfe\xba\xbe"), ("text", b"no class")], "path string, content binary")
    parsed = classfile.parse_classes(bad)
    assert classfile.rejected(parsed).count() == 5
    assert classfile.classes(parsed).count() == classfile.edges(parsed).count() == classfile.annotations(parsed).count() == 0


def test_nested_archives(spark):
    inner = zipped([("a/X.class", b"same"), ("docs/readme.MD", b"# hi"), ("empty/", b"")])
    outer = zipped([("BOOT-INF/lib/in.jar", inner), ("a/X.class", b"same"), ("broken.zip", b"no zip")])
    got = {r.path: (r.depth, bytes(r.content)) for r in archives.expand_archives(files(spark, ("o.jar", outer), ("B.java", b"class B"), ("bad.jar", b"??"))).collect()}
    assert got == {
        "BOOT-INF/lib/in.jar": (1, inner), "a/X.class": (1, b"same"), "broken.zip": (1, b"no zip"), "BOOT-INF/lib/in.jar:a/X.class": (2, b"same"),
        "BOOT-INF/lib/in.jar:docs/readme.MD": (2, b"# hi"), "B.java": (0, b"class B"),
    }


def test_depth_ceiling(spark):
    body = zipped([("x.txt", b"x")])
    for i in range(10):
        body = zipped([(f"n{i}.zip", body)])
    depths = [r.depth for r in archives.expand_archives(files(spark, ("top.zip", body))).select("depth").collect()]
    assert max(depths) == archives.MAX_DEPTH + 1


def test_masking_stamp_and_index(spark, tmp_path):
    jar = [zipped([("p/A.class", bytes([i])), ("module-info.class", b"m"), ("r.txt", b"t" * i)]) for i in range(3)]
    entries = archives.expand_archives(files(spark, *((f"{i}.jar", j) for i, j in enumerate(jar)))).withColumn("node_type", archives.node_type(F.col("name")))
    kept = archives.mask_duplicates(entries)
    assert sorted((r.path, r.classpath_idx) for r in kept.collect()) == [("module-info.class", 0), ("module-info.class", 1), ("module-info.class", 2), ("p/A.class", 0), ("r.txt", 0)]
    assert sorted(r.length for r in archives.indexed_resources(entries).collect()) == [1, 2]
    assert archives.content_stamp(entries.where("name = 'r.txt'")).first()[0] == f"{int(NOW.timestamp() * 1000)}_3_3"
    assert archives.content_stamp(entries.where("false")).first()[0] == "0_0_0"
    os.makedirs(tmp_path / "d" / "e")
    (tmp_path / "d" / "e" / "t.txt").write_text("x")
    assert [r.path for r in archives.read_entries(spark, [str(tmp_path / "d")]).collect()] == ["e/t.txt"]


def test_manifest_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "path string, mtime int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 1)], "path string, mtime int")
    assert sorted(map(tuple, archives.manifest_changes(old, new, "path", ["mtime"]).collect())) == [("b", "modified"), ("d", "added")]
    assert sorted(map(tuple, archives.manifest_changes(new, old, "path", ["mtime"]).collect())) == [("b", "modified"), ("d", "removed")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/X.txt"), (2, "a\\.\\X.txt"), (3, "../x"), (4, "/etc"), (5, "C:/x"), (6, None), (7, "a//X.txt"), (8, "plain")], "id long, path string")
    plan = lambda policy: {r.id: (r.action, r.target) for r in sinks.export_plan(df, "path", "id", policy, chunk=2).collect()}
    bad = {i: ("reject", None) for i in (3, 4, 5, 6)}
    assert plan("SKIP") == bad | {1: ("write", "a/X.txt"), 2: ("skip", "a/X.txt"), 7: ("skip", "a/X.txt"), 8: ("write", "plain")}
    assert plan("OVERWRITE") == bad | {1: ("skip", "a/X.txt"), 2: ("skip", "a/X.txt"), 7: ("write", "a/X.txt"), 8: ("write", "plain")}
    assert plan("RENAME") == bad | {1: ("write", "a/X.txt"), 2: ("write", "a/X_2.txt"), 7: ("write", "a/X_3.txt"), 8: ("write", "plain")}
    done = sinks.export_plan(df, "path", "id", "SKIP")
    assert tuple(sinks.export_counts(done).first()) == (2, 2, 4)
    sinks.export_tables(done, str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 8]


def test_unreadable_archives_are_reported(spark):
    good = zipped([("a.txt", b"a" * 100)])
    torn = bytearray(zipped([("a.txt", b"a" * 100), ("b.txt", b"b")]))
    torn[35] ^= 1
    outer = zipped([("in/broken.zip", b"no zip"), ("fine.zip", good)])
    got = archives.unreadable(files(spark, ("o.jar", outer), ("bad.JAR", b"??"), ("torn.zip", bytes(torn)), ("good.jar", good), ("plain.txt", b"??"))).collect()
    assert sorted((r.archive, r.path) for r in got) == [("bad.JAR", "bad.JAR"), ("o.jar", "in/broken.zip"), ("torn.zip", "torn.zip" if any(r.path == "torn.zip" for r in got) else "a.txt")]
    assert all(r.error for r in got)


def test_class_path_of_several_kinds(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / f"{n}.jar").write_bytes(zipped([(f"{n}.txt", n.encode())]))
    os.makedirs(tmp_path / "open.jar" / "d")
    (tmp_path / "open.jar" / "d" / "z.txt").write_text("z")
    elements = [str(tmp_path / "y.jar"), str(tmp_path / "open.jar"), f"file:{tmp_path}/x.jar", str(tmp_path / "y.jar")]
    entries = archives.read_entries(spark, elements)
    assert sorted((r.classpath_idx, r.path) for r in entries.collect()) == [(0, "y.txt"), (1, "d/z.txt"), (2, "x.txt"), (3, "y.txt")]
    assert sorted(r.classpath_idx for r in archives.elements_with(entries, ["y.txt", "none"]).collect()) == [0, 3]
    assert sorted(r.classpath_idx for r in archives.elements_without(entries, ["y.txt"]).collect()) == [1, 2]


def test_latest_change(spark):
    rows = files(spark, ("a", b""), ("b", b""))
    ms = int(NOW.timestamp() * 1000)
    assert archives.latest_change(rows).first()[0] == ms
    assert archives.latest_change(rows, F.lit(NOW)).first()[0] == archives.latest_change(rows.where("false")).first()[0] == 0


def test_scan_extended_upwards(spark):
    entries = archives.mask_duplicates(archives.read_entries(spark, [small_jar()])).where("node_type = 'CLASS_FILE'").cache()
    whole = {r.name: r for r in classfile.parse_classes(entries).where("error is null").collect()}
    above = {n: {x for x in (r.superclass, *r.interfaces, *(a.annotation for m in (r, *r.fields, *r.methods) for a in m.annotations), *(a.annotation for m in r.methods for a in m.parameter_annotations), *(t for m in r.methods for t in m.throws), *(c.outer for c in r.containment if c.inner == n)) if x in whole} for n, r in whole.items()}
    deep = {n: set() for n in whole}
    for n in whole:
        todo = [n]
        while todo:
            for up in above[todo.pop()] - deep[n]:
                deep[n].add(up)
                todo.append(up)
    start = max(sorted(whole), key=lambda n: len(deep[n] - {n}))
    assert deep[start] - {start}
    first = classfile.parse_classes(entries.where(F.col("path") == start + ".class"))
    got = [r.name for r in classfile.extend_upwards(first, entries).collect()]
    assert sorted(got) == sorted(deep[start] | {start})
    none = spark.createDataFrame([(n,) for n in above[start]], "name string")
    assert [r.name for r in classfile.extend_upwards(first, entries, none).collect()] == [start]
    entries.unpersist()


def test_inner_classes(spark):
    jar = next(j for j in sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize) if sum("$" in n for n in zipfile.ZipFile(j).namelist()) > 10)
    parsed = classfile.parse_classes(archives.read_entries(spark, [jar]).where("node_type = 'CLASS_FILE'")).where("error is null").cache()
    names = {r.name for r in parsed.select("name").collect()}
    outer = {(r.src, r.dst) for r in classfile.edges(parsed).where("rel = 'outer'").collect()}
    assert outer and len(outer) == classfile.edges(parsed).where("rel = 'outer'").count()
    assert all(x.startswith(y + "$") for x, y in outer if x in names and y in names)
    for r in parsed.where("enclosing_method is not null").collect():
        at, method = r.enclosing_method.rsplit(".", 1)
        assert (r.name, at) in outer and method
        rows = parsed.where(F.col("name") == at).select("methods").collect()
        assert method == "<clinit>" or not rows or method in {m.name for m in rows[0].methods}
    parsed.unpersist()


def test_annotated_parameters():
    u2 = lambda n: n.to_bytes(2, "big")
    utf = lambda t: b"\x01" + u2(len(t)) + t.encode()
    pool = [utf("p/A"), b"\x07" + u2(1), utf("m"), utf("(II)V"), utf("RuntimeVisibleParameterAnnotations"), utf("Lp/Note;"), utf("InnerClasses"), utf("EnclosingMethod"),
            utf("p/B"), b"\x07" + u2(9), utf("run"), utf("()V"), b"\x0c" + u2(11) + u2(12)]
    notes = b"\x02" + u2(0) + u2(1) + u2(6) + u2(0)
    method = u2(1) + u2(3) + u2(4) + u2(1) + u2(5) + len(notes).to_bytes(4, "big") + notes
    inner = u2(2) + u2(2) + u2(10) + u2(0) + u2(0) + u2(2) + u2(0) + u2(0) + u2(0)

    def parsed(at, inner=inner):
        attrs = u2(2) + u2(7) + len(inner).to_bytes(4, "big") + inner + u2(8) + (4).to_bytes(4, "big") + u2(10) + u2(at)
        return classfile.parse_class(b"\xca\xfe\xba\xbe" + u2(0) + u2(61) + u2(len(pool) + 1) + b"".join(pool) + u2(1) + u2(2) + u2(0) + u2(0) + u2(0) + u2(1) + method + attrs)

    got = parsed(13)
    assert got["methods"][0]["parameter_annotations"] == [{"parameter": 1, "annotation": "p/Note", "params": "{}"}]
    assert (got["containment"], got["enclosing_method"]) == ([{"inner": "p/A", "outer": "p/B"}], "p/B.run")
    assert parsed(0)["enclosing_method"] == "p/B.<clinit>"
    with pytest.raises(ValueError):
        parsed(13, u2(1) + u2(2) + u2(2) + u2(0) + u2(0))
