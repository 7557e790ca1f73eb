"""Generic signatures, aligned parameters, and paths of nested regions."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import signatures as S
from lodeframe.operators import relations as R
from lodeframe.sources import classfile

GENERIC = """package g;
import java.util.*;
public class Box<T extends Comparable<? super T> & Runnable, U> extends AbstractList<Map<String, ? extends U[]>> implements Iterable<Map<String, ? extends U[]>> {
    Map.Entry<List<?>, int[][]> pair;
    Outer<T>.Inner<U>.Deep deep;
    @Deprecated <X extends Exception, Y> List<? super X> make(final Map<T, X[]> a, int b, long[][] c, @Mark Y d) throws X { return null; }
    public Map<String, ? extends U[]> get(int i) { return null; }
    public int size() { return 0; }
    class Member { Member(@Mark T t, List<U> us) { } }
    enum Kind { A("x", null); Kind(@Mark String s, List<String> more) { } }
    void local(int outer) { class Local { int keep() { return outer; } Local(@Mark T t) { } } }
    @interface Mark { }
    static class Outer<A> { class Inner<B> { class Deep { } } }
}"""


def test_nodes_of_a_signature():
    nodes = S.Signature("<T:Ljava/lang/Object;U::Ljava/lang/Runnable;:La/B<-TT;>;>(Ljava/util/Map$Entry<[[I*+TU;>.In<TT;>.Deep;J)V^TT;").read("method")
    shown = [(n["id"], n["parent"], n["role"], n["kind"], n["name"], n["dims"], n["wildcard"]) for n in nodes]
    assert shown == [
        (0, None, "type_parameter", "parameter", "T", 0, None), (1, 0, "class_bound", "class", "java/lang/Object", 0, None), (2, None, "type_parameter", "parameter", "U", 0, None),
        (3, 2, "interface_bound", "class", "java/lang/Runnable", 0, None), (4, 2, "interface_bound", "class", "a/B", 0, None), (5, 4, "argument", "variable", "T", 0, "-"),
        (6, None, "parameter", "class", "java/util/Map$Entry", 0, None), (7, 6, "argument", "base", "I", 2, None), (8, 6, "argument", "any", None, 0, None), (9, 6, "argument", "variable", "U", 0, "+"),
        (10, 6, "inner", "class", "In", 0, None), (11, 10, "argument", "variable", "T", 0, None), (12, 10, "inner", "class", "Deep", 0, None),
        (13, None, "parameter", "base", "J", 0, None), (14, None, "result", "base", "V", 0, None), (15, None, "throws", "variable", "T", 0, None),
    ]


def test_malformed_signatures_are_null_with_a_reason(spark):
    bad = ["", "(", "()", "()VV", "(V)V", "()[V", "(Ljava/lang/String)V", "(Ljava/util/List<>;)V", "(Ljava/util/List<I>;)V", "(L;)V", "<>()V", "(TT)V", "()V^I", "x()V", "(" + "La<" * 300 + "*" + ">;" * 300 + ")V", "(La/;)V"]
    rows = S.with_nodes(spark.createDataFrame([(s, "mine") for s in bad] + [(None, "mine")], "s string, error string"), "s", "method").collect()
    got = {r["s"]: (r["nodes"], r["error"]) for r in rows}
    assert got.pop(None) == (None, None)
    # An empty list of type parameters is read as none.
    assert got.pop("<>()V")[0] is not None
    # What is thrown is read like any type.
    assert got.pop("()V^I")[0] is not None
    assert all(n is None and e for n, e in got.values()), got


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("generic")
    (base / "Box.java").write_text(GENERIC)
    try:
        subprocess.run(["javac", "--release", "17", "-parameters", "-Xlint:none", "-d", str(base / "out"), str(base / "Box.java")], check=True, capture_output=True)
    except OSError:
        pytest.skip("no compiler")
    rows = [(p.name, bytearray(p.read_bytes())) for p in sorted((base / "out").rglob("*.class"))]
    return classfile.parse_classes(spark.createDataFrame(rows, "path string, content binary")).cache()


def tiles(text, nodes, kind):
    """Whether the top nodes and the signs between them are the whole text."""
    top = [n for n in nodes if n["parent"] is None]
    out = "".join(text[n["start"] : n["end"]] for n in top)
    signs = [c for c in text if c in "()^"] if kind == "method" else []
    return len(out) + len(signs) + 2 * any(n["role"] == "type_parameter" for n in top) == len(text)


def test_signatures_of_the_compiler(parsed):
    ok = parsed.where("error is null")
    for kind, texts in (("class", ok.select("signature")), ("method", classfile.methods(parsed).select("signature")), ("field", classfile.fields(parsed).select("signature")), ("method", classfile.methods(parsed).select(F.col("descriptor").alias("signature")))):
        rows = S.with_nodes(texts.where("signature is not null"), "signature", kind).collect()
        assert rows and [(r["signature"], r["error"]) for r in rows if r["error"]] == []
        for r in rows:
            assert tiles(r["signature"], r["nodes"], kind), r["signature"]
            ends = {n["id"]: n for n in r["nodes"]}
            assert all(n["parent"] is None or n["role"] == "inner" or ends[n["parent"]]["start"] <= n["start"] <= n["end"] <= ends[n["parent"]]["end"] for n in r["nodes"])
    deep = S.with_nodes(classfile.fields(parsed).where("name = 'deep'"), "signature", "field")
    assert deep.select(S.classes_named(F.col("nodes"))).first()[0] == ["g/Box$Outer", "g/Box$Outer$Inner", "g/Box$Outer$Inner$Deep"]
    made = S.with_nodes(classfile.methods(parsed).where("name = 'make'"), "signature", "method")
    assert made.select(S.parts_of(F.col("signature"), F.col("nodes"), "parameter")).first()[0] == ["Ljava/util/Map<TT;[TX;>;", "I", "[[J", "TY;"]


def test_parameters_are_aligned_at_the_last(parsed):
    rows = {}
    for r in classfile.method_parameters(parsed).orderBy("position").collect():
        rows.setdefault((r["owner"], r["name"]), []).append((r["descriptor"], r["signature"], r["parameter"], r["annotations"] or []))
    assert rows["g/Box", "make"] == [("Ljava/util/Map;", "Ljava/util/Map<TT;[TX;>;", "a", []), ("I", "I", "b", []), ("[[J", "[[J", "c", []), ("Ljava/lang/Object;", "TY;", "d", ["g/Box$Mark"])]
    # The outer instance of a member class, and name and ordinal of an enum constant, have no generic type and no annotations.
    member = rows["g/Box$Member", "<init>"]
    assert [x[1] for x in member] == [None, "TT;", "Ljava/util/List<TU;>;"] and [x[3] for x in member] == [[], ["g/Box$Mark"], []] and member[1][2] == "t"
    kind = rows["g/Box$Kind", "<init>"]
    assert [x[0] for x in kind] == ["Ljava/lang/String;", "I", "Ljava/lang/String;", "Ljava/util/List;"]
    assert [x[1] for x in kind] == [None, None, "Ljava/lang/String;", "Ljava/util/List<Ljava/lang/String;>;"] and [x[3] for x in kind] == [[], [], ["g/Box$Mark"], []]
    assert ("g/Box", "size") not in rows


def test_region_paths_against_all_pairs(spark):
    draw = random.Random(4)
    regions = [(f"r{i}", draw.randrange(1000), draw.choice([1, 5, 40, 300, 5000, 0]), i) for i in range(120)] + [("all", -10, 10_000_000, 999)]
    points = [draw.randrange(-20, 1400) for _ in range(200)] + [5, 5, 5, None]
    got = R.region_paths(spark.createDataFrame([(p,) for p in points], "point long"), spark.createDataFrame(regions, "region string, start long, length long, ordinal int"), 16, "ordinal").collect()
    want = {}
    for p in {p for p in points if p is not None}:
        around = sorted((r for r in regions if r[1] <= p < r[1] + r[2]), key=lambda r: (-r[2], -r[3]))
        if around:
            want[p] = (len(around), " > ".join(r[0] for r in around), around[-1][0])
    assert {r["point"]: (r["n_regions"], r["path"], r["innermost"]) for r in got} == want and len(got) == len(want)


def test_nearest_after(spark):
    draw = random.Random(9)
    queries = [(draw.choice(["a", "b", None]), draw.randrange(-50, 50)) for _ in range(60)]
    marks = [(draw.choice(["a", "b", None]), draw.randrange(-50, 50), f"m{i}") for i in range(40)]
    for strict in (True, False):
        got = R.nearest_after(spark.createDataFrame(queries, "k string, at long"), spark.createDataFrame(marks, "k string, at long, v string"), "k", "at", "v", strict, chunk=7).collect()
        want = []
        for k, at in queries:
            later = [(m[1], m[2]) for m in marks if m[0] == k and (m[1] > at or not strict and m[1] == at)]
            first = min((x for x, _ in later), default=None)
            want.append((k, at, max((v for x, v in later if x == first), default=None)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
