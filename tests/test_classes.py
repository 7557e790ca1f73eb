"""The catalog over class tables on small fixtures."""

import random

from pyspark.sql import functions as F

from lodeframe.functions import predicates as P
from lodeframe.operators import classes as C, search
from lodeframe.operators.graph import declared_ancestor

CLASSES = [("a/Service", 0x201, None, False), ("a/Mark", 0x2601, None, False), ("a/Color", 0x4001, None, False), ("a/Impl", 1, "java/lang/Object", False),
           ("a/Child", 1, "a/Impl", False), ("a/Point", 1, None, True), ("a/Sub", 0x201, None, False)]
EDGES = [("implements", "a/Impl", "a/Sub", 0), ("implements", "a/Sub", "a/Service", 0), ("extends", "a/Child", "a/Impl", 0), ("implements", "a/Impl", "a/Mark", 1), ("outer", "a/C$D$E", "a/C$D", 0), ("outer", "a/C$D", "a/C", 0)]


def rows(df, *columns):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect())


def tables(spark):
    return spark.createDataFrame(CLASSES, "name string, modifiers int, superclass string, is_record boolean"), spark.createDataFrame(EDGES, "rel string, src string, dst string, pos int")


def test_kinds_and_lookups(spark):
    classes, edges = tables(spark)
    kinds = {k: rows(C.of_kind(classes, k), "name") for k in C.KINDS}
    assert kinds == {
        "standard": ["a/Child", "a/Color", "a/Impl", "a/Point"], "interface": ["a/Service", "a/Sub"], "interface_or_annotation": ["a/Mark", "a/Service", "a/Sub"],
        "annotation": ["a/Mark"], "enum": ["a/Color"], "record": ["a/Point"],
    }
    assert rows(C.named(classes, "a.Impl"), "name") == ["a/Impl"]
    assert rows(C.implemented_interfaces(classes, edges), "name") == ["a/Mark", "a/Service", "a/Sub"]
    assert rows(C.subclasses_of(classes, edges, "a/Impl"), "name", "is_direct") == [("a/Child", True)]
    assert rows(C.subclasses_of(classes, edges, C.ROOT), "name", "is_direct") == [("a/Child", False), ("a/Color", False), ("a/Impl", True), ("a/Point", False)]
    assert tuple(C.class_statistics(classes, classes.limit(2), classes.limit(3), classes.limit(0)).first()) == (7, 3, 1, 1, 3, 2, 3, 0)


def test_interfaces_and_implementers(spark):
    classes, edges = tables(spark)
    want = [("a/Child", "a/Mark", False), ("a/Child", "a/Service", False), ("a/Child", "a/Sub", False), ("a/Impl", "a/Mark", True), ("a/Impl", "a/Service", False), ("a/Impl", "a/Sub", True), ("a/Sub", "a/Service", True)]
    assert rows(C.all_interfaces(edges), "name", "interface", "is_direct") == want
    assert rows(C.concrete_implementers(classes, edges), "interface", "name") == [("a/Mark", "a/Impl"), ("a/Service", "a/Impl"), ("a/Sub", "a/Impl")]
    assert rows(C.enclosing_classes(edges), "name", "outer", "depth") == [("a/C$D", "a/C", 1), ("a/C$D$E", "a/C", 2), ("a/C$D$E", "a/C$D", 1)]
    over = C.with_overflow(spark.createDataFrame([("g", x) for x in "dacb"] + [("h", "x")], "g string, item string"), ["g"], "item", 2)
    assert sorted(map(str, over.collect())) == sorted(map(str, spark.createDataFrame([("g", 1, "a", None), ("g", 2, "b", None), ("g", 3, None, 2), ("h", 1, "x", None)], over.schema).collect()))


def test_override_orders(spark):
    # K extends P; K implements A, B; B extends A; P implements Z.
    edges = spark.createDataFrame([("extends", "K", "P", 0), ("implements", "K", "A", 0), ("implements", "K", "B", 1), ("implements", "B", "A", 0), ("implements", "P", "Z", 0)], "rel string, src string, dst string, pos int")
    kinds = spark.createDataFrame([("K", False), ("P", False), ("A", True), ("B", True), ("Z", True)], "name string, is_interface boolean")
    order = lambda **o: [r.declares for r in C.override_order(edges, kinds, **o).where("name = 'K'").orderBy("prio").collect()]
    assert order() == ["K", "P", "Z", "B", "A"]
    assert order(fields=True) == ["K", "A", "B", "Z", "P"]
    assert order(roots=kinds.where("name = 'K'")) == ["K", "P", "Z", "B", "A"] and C.override_order(edges, kinds, roots=kinds.where("name = 'P'")).count() == 2
    members = spark.createDataFrame([("P", 0, "f", "()V"), ("A", 0, "f", "()V"), ("A", 1, "g", "()V"), ("B", 0, "g", "()V"), ("P", 1, "<init>", "()V")], "owner string, pos int, name string, descriptor string")
    seen = C.visible_members(C.override_order(edges, kinds), members, ["name", "descriptor"])
    assert rows(seen.where("class_name = 'K'"), "name", "owner") == [("f", "P"), ("g", "B")]
    assert rows(C.has_member(C.override_order(edges, kinds), members, "g"), "name") == ["A", "B", "K"]
    assert rows(C.first_member(members, "g"), "owner", "pos") == [("A", 1), ("B", 0)]
    assert rows(C.declared_methods(members, constructors=True, normal=False), "owner") == ["P"] and C.declared_methods(members, "f").count() == 2


def plain_orders(edges, name, interfaces):
    """(fields, methods) of one class by the rules themselves, as recursions."""
    up = {s: d for r, s, d, _ in edges if r == "extends"}
    faces = {}
    for r, s, d, p in sorted(edges, key=lambda e: e[3]):
        if r == "implements":
            faces.setdefault(s, []).append(d)

    def reach(c):
        out = list(dict.fromkeys(faces.get(c, [])))
        for x in out:
            out += [y for y in faces.get(x, []) if y not in out]
        return out

    def all_of(c):
        out = []
        while c:
            out += [x for x in reach(c) if x not in out]
            c = up.get(c)
        return out

    def field(c, out):
        if c not in out:
            out.append(c)
            for x in (*all_of(c), *([up[c]] if c in up else [])):
                field(x, out)
        return out

    def method(c, out):
        if c in out:
            return out
        if c not in interfaces:
            out.append(c)
            if c in up:
                method(up[c], out)
        else:
            out.insert(min((out.index(x) for x in all_of(c) if x in out), default=len(out)), c)
        for x in all_of(c):
            method(x, out)
        return out

    return field(name, []), method(name, [])


def test_override_orders_of_random_hierarchies(spark):
    draw = random.Random(6)
    edges, kinds = [("implements", "1K", "1Y", 0), ("implements", "1K", "1I", 1), ("implements", "1I", "1X", 0), ("implements", "1X", "1Y", 0), ("extends", "2K", "2P", 0), ("implements", "2P", "2Z", 0)], []
    for n in range(25):
        names = [f"{n}_{i}" for i in range(9)]
        faces = names[:5]
        for i, x in enumerate(names):
            if i > 5:
                edges.append(("extends", x, names[draw.randrange(5, i)], 0))
            below = faces[:i]
            for pos, y in enumerate(draw.sample(below, draw.randrange(0, min(3, len(below)) + 1))):
                edges.append(("implements", x, y, pos))
        kinds += [(x, x in faces) for x in names]
    kinds += [(x, x[1] in "YIXZ") for x in ("1K", "1Y", "1I", "1X", "2K", "2P", "2Z")]
    interfaces = {x for x, i in kinds if i}
    tables = spark.createDataFrame(edges, "rel string, src string, dst string, pos int"), spark.createDataFrame(kinds, "name string, is_interface boolean")
    for fields in (True, False):
        got = {}
        for r in C.override_order(*tables, fields=fields).orderBy("prio").collect():
            got.setdefault(r["name"], []).append((r["prio"], r["declares"]))
        want = {x: list(enumerate(plain_orders(edges, x, interfaces)[0 if fields else 1])) for x, _ in kinds}
        assert got == want
    assert [d for _, d in got["1K"]] == ["1K", "1I", "1X", "1Y"]
    faces = C.ordered_interfaces(tables[0], spark.createDataFrame([("1K",), ("2K",)], "name string"))
    assert rows(faces, "name", "prio", "interface") == [("1K", 0, "1Y"), ("1K", 1, "1I"), ("1K", 2, "1X"), ("2K", 0, "2Z")]


def test_declared_ancestor_of_random_hierarchies(spark):
    draw, edges = random.Random(3), []
    for i in range(1, 30):
        for pos, j in enumerate(draw.sample(range(i), min(i, draw.randrange(0, 4)))):
            edges.append((f"k{i}", f"k{j}", pos))
    parents = {}
    for s, d, _ in sorted(edges, key=lambda e: e[2]):
        parents.setdefault(s, []).append(d)

    def above(c):
        return {d for p in parents.get(c, []) for d in (p, *above(p))}

    def walk(c, hits):
        for p in parents.get(c, []):
            if p in hits:
                return p
            if (found := walk(p, hits)) is not None:
                return found

    pairs = [(f"k{draw.randrange(30)}", f"k{draw.randrange(30)}") for _ in range(150)] + [("k3", "k3")]
    want = {(a, b): a if a == b else b if b in above(a) else walk(b, above(a)) for a, b in pairs}
    got = declared_ancestor(spark.createDataFrame(edges, "src string, dst string, pos int"), spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {(r["a"], r["b"]): r["ancestor"] for r in got} == want and len(got) == len(want)


def test_unwrapping_knows_every_container(spark):
    marks = spark.range(10_001).select(F.lit("class").alias("target_kind"), F.concat(F.lit("k"), "id").alias("owner"), F.concat(F.lit("Tags"), "id").alias("annotation"),
                                       F.lit('{"value": [{"annotation": "Tag", "params": "1"}]}').alias("params"))
    boxes = marks.select(F.col("annotation").alias("container"), F.lit("Tag").alias("annotation"))
    found = C.unwrap_repeatable(marks, boxes.unionByName(boxes.limit(5)))
    assert found.where("annotation = 'Tag'").count() == found.count() == 10_001


def test_annotations(spark):
    marks = spark.createDataFrame([
        ("class", "P", "M"), ("class", "M", "N"), ("class", "N", "M"), ("class", "M", "java/lang/annotation/Inherited"), ("class", "Q", "N"), ("method", "Q", "M"),
    ], "target_kind string, owner string, annotation string")
    edges = spark.createDataFrame([("extends", "K", "P", 0)], "rel string, src string, dst string, pos int")
    found = C.class_annotations(marks, edges, C.inherited_annotations(marks))
    assert rows(found.where("owner IN ('K', 'P', 'Q')"), "owner", "annotation", "is_direct") == [("K", "M", False), ("P", "M", True), ("P", "N", False), ("Q", "M", False), ("Q", "N", True)]
    assert rows(C.member_annotations(marks, "method"), "owner", "annotation", "is_direct") == [("Q", "M", True), ("Q", "N", False)]
    boxed = spark.createDataFrame([("class", "K", "Tags", '{"value": [{"annotation": "Tag", "params": "{}"}, {"annotation": "Tag", "params": "1"}]}'), ("class", "K", "M", "{}")], "target_kind string, owner string, annotation string, params string")
    assert rows(C.unwrap_repeatable(boxed, spark.createDataFrame([("Tags", "Tag")], "container string, annotation string")), "annotation", "params") == [("M", "{}"), ("Tag", "1"), ("Tag", "{}")]


def test_usages(spark):
    refs = spark.createDataFrame([
        ("METHOD_CALL", "com/example/Target", "call", "()I"), ("FIELD_ACCESS", "com/example/Target", "value", "I"), ("FIELD", "com/example/Holder", "target", "Lcom/example/Target;"), ("METHOD_CALL", "com/other/Thing", "call", "()V"),
    ], "op string, owner string, name string, descriptor string")
    use = lambda q: rows(C.find_usages(refs, q), "op", "owner")
    assert use("com.example.Target") == [("FIELD", "com/example/Holder"), ("FIELD_ACCESS", "com/example/Target"), ("METHOD_CALL", "com/example/Target")]
    assert use("com.example.Target#call") == [("METHOD_CALL", "com/example/Target")] and use("com.example.Target#value") == [("FIELD_ACCESS", "com/example/Target")]
    assert use("#call") == [] and use("#") == [] and use(" ") == []


def test_line_match_as_the_jvm_has_it(spark):
    df = spark.createDataFrame([("$the",), ("the end",), ("éthe",), ("CAFÉ The",), ("\t// note",), ("a (b",)], "l string")
    hit = lambda q, **o: rows(df.where(P.line_match(F.col("l"), q, **o)), "l")
    assert hit("the", whole_word=True) == ["CAFÉ The", "the end"]
    assert hit("café") == ["CAFÉ The"] and hit("  ") == [] and hit("(b", whole_word=True) == ["a (b"]
    assert hit(r"\p{Lu}\p{Lu}", regex=True, case_sensitive=True) == ["CAFÉ The"] and hit("(?P<n>x)", regex=True) == [] and hit("(", regex=True) == []
    assert rows(df.where(P.is_comment_line(F.col("l"))), "l") == ["\t// note"]
    assert rows(search.comment_hits(df.withColumn("p", F.lit("p")), "p", "l", "NOTE"), "match_line", "line_number") == [("// note", 1)]


def plain_merge(providers, limit, excluded):
    """The merge as one loop."""
    out, seen = [], set()
    for own in providers:
        added = 0
        for h in sorted(own, key=lambda h: (h[0], h[1], h[2]))[: search.PROVIDER_CAP]:
            if len(out) >= 2 * limit or added >= max(1, 2 * limit // len(providers)):
                break
            key = (h[0], h[1], h[3])
            if not excluded(h[0]) and key not in seen:
                seen.add(key)
                out.append(h)
                added += 1
    return sorted(out, key=lambda h: (h[4], h[1]))[:limit]


def test_merge_against_a_plain_loop(spark):
    hits = lambda n, kind, text: [(f"p/{'hidden' if i % 5 == 0 else 'C'}{i % 17}", i % 7 + 1, f"{text}{i}", kind, search.TYPES.index(kind)) for i in range(n)]
    for limit, sizes in ((10, (40, 30, 5)), (2, (9, 9, 9)), (1, (3, 4, 5)), (300, (900, 20, 20))):
        own = [hits(sizes[0], "CODE_TEXT", "a"), hits(sizes[1], "CODE_TEXT", "b"), hits(sizes[2], "CLASS", "c")]
        got = search.merge_hits([spark.createDataFrame(h, search.HIT) for h in own], limit, ["*hidden*", " "])
        assert [tuple(r) for r in got.collect()] == plain_merge(own, limit, lambda p: "hidden" in p)
    providers = {"CLASS": spark.createDataFrame(hits(1, "CLASS", "x"), search.HIT), "BYTECODE": spark.createDataFrame(hits(2, "BYTECODE", "y"), search.HIT)}
    assert len(search.in_scope(providers, "CLASS")) == 1 and len(search.in_scope(providers, "ALL")) == 2


def test_override_orders_form_no_group_a_class(spark):
    edges = spark.createDataFrame([("extends", "K", "P", 0), ("implements", "P", "Z", 0), ("implements", "K", "A", 0)], "rel string, src string, dst string, pos int")
    kinds = spark.createDataFrame([("K", False), ("P", False), ("A", True), ("Z", True)], "name string, is_interface boolean")
    found = C.override_order(edges, kinds)
    assert rows(found.where("name = 'K'"), "prio", "declares") == [(0, "K"), (1, "P"), (2, "Z"), (3, "A")]
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
