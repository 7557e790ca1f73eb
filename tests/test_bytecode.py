"""Instruction rows, usage search, the use graph and control flow, on classes that the compiler makes."""

import re
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import classes as C, flow, search, usages
from lodeframe.sources import bytecode, classfile

SOURCES = {
    "Target": "package com.example; public class Target { public static int value; public void call() {} }",
    "Caller": "package com.example; public class Caller {\n public void run() {\n  Target.value = 1;\n  new Target().call();\n }\n}",
    "Holder": "package com.example; public class Holder { private Target target; public Target getTarget() { return target; } public void setTarget(Target target) { this.target = target; } }",
    "Base": "package com.example; public class Base implements Named { int n; protected int twice(int x) { return 2 * x; } static long fact(int n) { return n < 2 ? 1 : n * fact(n - 1); } public String name() { return \"base\"; } }",
    "Named": "package com.example; public interface Named { String name(); default int size() { return name().length(); } }",
    "Derived": """package com.example;
public class Derived extends Base {
    static final double[][] GRID = new double[3][4];
    int sum(int a, long b, double[] c, String... d) { n = twice(a); n += n; return n + size() + (int) b; }
    Runnable later(Target t) { return () -> { t.call(); sum(1, 2L, null); }; }
    Class<?> kind(Object o) { return o instanceof Target[] ? Target[].class : ((Base) o).getClass(); }
    class Inner { int get() { return n; } }
    static int branches(int x, String s) {
        int out = 0;
        for (int i = 0; i < x; i++) { if (i % 3 == 0) continue; out += i; }
        switch (x) { case 1: out++; break; case 2: case 3: out--; break; case 7: return out; default: out = 5; }
        switch (x) { case -1000: out++; break; case 1000000: out += 300; break; }
        try { out += s.length(); } catch (NullPointerException e) { out = -1; } finally { out++; }
        while (true) { if (out > 100) break; out *= 2; if (out == 64) throw new IllegalStateException("x" + out); }
        synchronized (s) { out += 40000; }
        return out;
    }
    static int wide(int x) { VARIABLES; int last = x; last += 1000; return last; }
}""".replace("VARIABLES", "; ".join(f"int v{i} = x" for i in range(260))),
}


@pytest.fixture(scope="module")
def compiled(tmp_path_factory):
    base = tmp_path_factory.mktemp("java")
    for name, text in SOURCES.items():
        (base / f"{name}.java").write_text(text)
    try:
        subprocess.run(["javac", "--release", "17", "-g", "-d", str(base / "out"), *map(str, base.glob("*.java"))], check=True, capture_output=True)
    except OSError:
        pytest.skip("no compiler")
    return base / "out"


@pytest.fixture(scope="module")
def entries(spark, compiled):
    rows = [(str(p.relative_to(compiled)), bytearray(p.read_bytes())) for p in sorted(compiled.rglob("*.class"))]
    rows += [("null", None), ("bad.class", bytearray(b"\xca\xfe\xba\xbe\x00"))]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3).cache()


@pytest.fixture(scope="module")
def decoded(entries):
    return bytecode.decode_bodies(entries).cache()


@pytest.fixture(scope="module")
def parsed(entries):
    return classfile.parse_classes(entries).cache()


def listing(path):
    """(method index, offset, op, what the comment names) of every instruction, and the exception tables, as the JDK lists them."""
    text = subprocess.run(["javap", "-p", "-c", "-l", str(path)], check=True, capture_output=True, text=True).stdout
    out, method, kind, lines, tables = [], -1, None, {}, {}
    for line in text.split("\n"):
        if line.strip() in ("Code:", "LineNumberTable:", "LocalVariableTable:", "Exception table:"):
            kind = line.strip()
            method += kind == "Code:"
        elif kind == "Code:" and (m := re.match(r"\s+(\d+): ([a-z][a-z_0-9]*)(.*)", line)):
            out.append((method, int(m[1]), m[2], m[3]))
        elif kind == "LineNumberTable:" and (m := re.match(r"\s+line (\d+): (\d+)", line)):
            lines.setdefault(method, {})[int(m[2])] = int(m[1])
        elif kind == "Exception table:" and (m := re.match(r"\s+(\d+)\s+(\d+)\s+(\d+)\s+(.*)", line)):
            tables.setdefault(method, []).append((int(m[1]), int(m[2]), int(m[3]), None if m[4] == "any" else m[4].removeprefix("Class ")))
        elif not line.strip():
            kind = None
    return out, lines, tables


def test_opcodes():
    known = {0: "nop", 8: "iconst_5", 20: "ldc2_w", 26: "iload_0", 46: "iaload", 54: "istore", 79: "iastore", 87: "pop", 96: "iadd", 120: "ishl", 132: "iinc", 133: "i2l", 147: "i2s", 148: "lcmp", 153: "ifeq", 167: "goto", 170: "tableswitch", 177: "return", 186: "invokedynamic", 201: "jsr_w"}
    assert len(bytecode.OPS) == len(set(bytecode.OPS)) == 202 and all(bytecode.OPS[i] == op for i, op in known.items())


def test_instructions_equal_the_listing_of_the_jdk(decoded, compiled):
    assert decoded.where("error is not null").count() == 0
    got = {}
    for r in bytecode.instructions(decoded).orderBy("full_path", "method_pos", "at").collect():
        got.setdefault(r["full_path"], {}).setdefault(r["method_pos"], []).append(r)
    tables = {}
    for r in bytecode.handlers(decoded).orderBy("full_path", "method_pos", "pos").collect():
        tables.setdefault((r["full_path"], r["method_pos"]), []).append((r["start"], r["end"], r["handler"], r["type"]))
    for path, methods in got.items():
        want, lines, exceptions = listing(compiled / path)
        for number, pos in enumerate(sorted(methods)):
            rows, own = methods[pos], [w[1:] for w in want if w[0] == number]
            assert [(r["offset"], r["op"].removesuffix("_w") if r["op"].startswith("ldc_") else r["op"]) for r in rows] == [(o, "ldc" if op == "ldc_w" else op.removesuffix("_w") if op in ("iinc_w", "iload_w", "istore_w") else op) for o, op, _ in own], (path, pos)
            line = 1
            for r, (offset, op, rest) in zip(rows, own):
                line = lines.get(number, {}).get(offset, line)
                assert r["line"] == line
                if r["kind"] in ("field", "call"):
                    shown = rest.split("//")[1].split(" ", 2)[2].strip()
                    member = f'"{r["name"]}":{r["descriptor"]}' if r["name"] == "<init>" else f'{r["name"]}:{r["descriptor"]}'
                    assert shown in (member, f'{r["owner"]}.{member}'), shown
                if r["kind"] == "jump":
                    assert [t["offset"] for t in r["targets"]] == [int(rest.split("//")[0])]
            assert tables.get((path, pos), []) == exceptions.get(number, []), (path, pos)
    assert len(got) >= 7 and sum(len(m) for c in got.values() for m in c.values()) > 500


def test_switches_and_wide_operands(decoded):
    rows = bytecode.instructions(decoded)
    table = rows.where("op = 'tableswitch'").first()
    assert [t["label"] for t in table["targets"]] == [*map(str, range(1, 8)), "default"]
    assert [t["label"] for t in rows.where("op = 'lookupswitch'").first()["targets"]] == ["-1000", "1000000", "default"]
    assert rows.where("op = 'iinc' AND value LIKE '% 1000'").count() == 1 and rows.where("op = 'istore' AND value = '260'").count() == 1
    assert rows.where("op = 'multianewarray'").first()["value"] == "2" and rows.where("kind = 'string' AND value = 'base'").count() == 1
    names = {(r["method"], r["position"]): (r["name"], r["descriptor"]) for r in bytecode.parameter_names(decoded).where("class_name = 'com/example/Derived'").collect()}
    assert [names["sum", i] for i in range(4)] == [("a", "I"), ("b", "J"), ("c", "[D"), ("d", "[Ljava/lang/String;")] and names["branches", 1][0] == "s"


def test_malformed_code_is_an_error_of_its_method(spark, compiled):
    data = (compiled / "com/example/Base.class").read_bytes()
    # The body of twice: iconst_2, iload_1, imul, ireturn.
    body = bytes([5, 27, 104, 172])
    assert data.count(body) == 1
    for broken in (bytes([5, 27, 104, 255]), bytes([5, 27, 104, 178]), bytes([5, 27, 196, 5])):
        df = spark.createDataFrame([("B.class", bytearray(data.replace(body, broken)))], "path string, content binary")
        rows = bytecode.decode_bodies(df)
        assert [r["method"] for r in rows.where("error is not null").collect()] == ["twice"] and bytecode.instructions(rows).where("method = 'twice'").count() == 0
        assert bytecode.instructions(rows).count() > 10
    assert bytecode.decode_bodies(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_usage_search(parsed, decoded):
    rows = usages.usage_rows(parsed, bytecode.instructions(decoded)).cache()
    find = lambda q: {(r["path"].rpartition("/")[2], r["type"], r["text"]) for r in usages.search_usages(rows, q).collect()}
    target = find("com.example.Target")
    assert ("Caller.class", "METHOD_CALL", "invokevirtual com/example/Target.call()V") in target and ("Caller.class", "CLASS_REFERENCE", "new com/example/Target") in target
    assert ("Holder.class", "FIELD_ACCESS", "field target Lcom/example/Target;") in target and ("Holder.class", "METHOD_CALL", "method setTarget(Lcom/example/Target;)V") in target
    assert ("Derived.class", "CLASS_REFERENCE", "class com/example/Target") in target and ("Derived.class", "CLASS_REFERENCE", "instanceof [Lcom/example/Target;") in target
    assert ("Caller.class", "METHOD_CALL", "invokevirtual com/example/Target.call()V") in find("com.example.Target#call")
    assert ("Caller.class", "FIELD_ACCESS", "putstatic com/example/Target.value I") in find("com.example.Target#value")
    assert find("#call") == find("#") == find("  ") == set()
    assert any(t.startswith("handle ") and "lambda$later$" in t for _, k, t in find("Derived#lambda") if k == "METHOD_CALL")
    assert ("Derived.class", "CLASS_REFERENCE", "extends com/example/Base") in find("Base") and ("Base.class", "CLASS_REFERENCE", "implements com/example/Named") in find("com.example.Named.class")
    one = usages.search_usages(rows, "com.example.Target#value").where("type = 'FIELD_ACCESS' AND text LIKE 'putstatic%'").first()
    assert (one["path"], one["line"]) == ("com/example/Caller.class", 3)
    rows.unpersist()


@pytest.fixture(scope="module")
def resolved(parsed, decoded):
    kinds = classfile.classes(parsed).select("name", C.is_kind("interface_or_annotation", F.col("modifiers")).alias("is_interface"))
    ok = parsed.where("error is null")
    edges = ok.where("superclass <> 'java/lang/Object'").select(F.lit("extends").alias("rel"), F.col("name").alias("src"), F.col("superclass").alias("dst"), F.lit(0).alias("pos"))
    edges = edges.unionByName(ok.select(F.lit("implements").alias("rel"), F.col("name").alias("src"), F.posexplode("interfaces").alias("pos", "dst")))
    orders = [C.override_order(edges, kinds, fields=f) for f in (False, True)]
    uses = usages.references(bytecode.instructions(decoded))
    return usages.resolve_uses(uses, orders[0], classfile.methods(parsed), orders[1], classfile.fields(parsed)).cache()


def test_use_graph(resolved, parsed, decoded):
    calls = {(r["src"].rpartition("/")[2], r["member"].partition("(")[0], r["target"].rpartition("/")[2], r["target_member"].partition("(")[0]) for r in usages.calls(resolved).collect()}
    assert {("Derived", "sum", "Base", "twice"), ("Derived", "sum", "Named", "size"), ("Caller", "run", "Target", "call"), ("Caller", "run", "Target", "<init>"), ("Base", "fact", "Base", "fact"), ("Derived", "<init>", "Base", "<init>"), ("Derived", "later", "Derived", "lambda$later$0")} <= calls
    assert not any(t == "Object" for _, _, t, _ in calls)
    outside = {(r["owner"], r["name"]) for r in usages.unresolved_calls(resolved).collect()}
    assert ("java/lang/String", "length") in outside and ("java/lang/Object", "getClass") in outside and ("java/lang/Object", "<init>") not in outside
    fields = {(r["src"].rpartition("/")[2], r["member"].partition("(")[0], r["target"].rpartition("/")[2], r["target_member"], r["access"]) for r in usages.field_users(resolved).collect()}
    assert {("Derived", "sum", "Base", "n", "read"), ("Derived", "sum", "Base", "n", "write"), ("Caller", "run", "Target", "value", "write"), ("Derived$Inner", "get", "Base", "n", "read")} <= fields
    counts = {(r["target"], r["target_member"]): (r["n_users"], r["self_use"]) for r in usages.use_counts(usages.calls(resolved)).collect()}
    assert counts["com/example/Base", "fact(I)J"] == (1, True) and counts["com/example/Target", "call()V"] == (2, False)
    assert [r["member"] for r in resolved.where("self_call").collect()] == ["fact(I)J"]
    outer = C.enclosing_classes(classfile.edges(parsed).withColumn("pos", F.lit(0)))
    own = {(r["src"], r["dst"], r["top_src"]) for r in usages.class_uses(resolved, outer, classfile.classes(parsed).where("not is_external")).collect()}
    assert ("com/example/Derived$Inner", "com/example/Base", "com/example/Derived") in own and ("com/example/Holder", "com/example/Target", "com/example/Holder") in own
    within = {(r["caller"], r["callee"]) for r in usages.calls_within(bytecode.instructions(decoded)).where("class_name = 'com/example/Base'").collect()}
    assert within == {("fact(I)J", "fact(I)J")}


def plain_flow(rows, handlers):
    """Blocks (first and last place) and edges of one method by loops over its instructions."""
    at = {r["offset"]: i for i, r in enumerate(rows)}
    lead = {0} | {at[h["handler"]] for h in handlers}
    for i, r in enumerate(rows):
        lead |= {at[t["offset"]] for t in r["targets"] or []}
        if r["kind"] == "switch" or r["op"] in flow.ENDS or r["kind"] == "jump" and r["op"] != "goto":
            lead.add(i + 1)
    lead = sorted(x for x in lead if x < len(rows))
    blocks = list(zip(lead, [x - 1 for x in lead[1:]] + [len(rows) - 1]))
    block = {x: i for i, (x, _) in enumerate(blocks)}
    edges = []
    for i, (_, end) in enumerate(blocks):
        r = rows[end]
        to = [(t["label"], block[at[t["offset"]]]) for t in r["targets"] or []]
        if r["kind"] == "switch":
            goals = [g for label, g in to if label != "default"]
            if r["op"] == "tableswitch":
                edges += [(i, g, f"{goals.count(g)} cases" if goals.count(g) > 1 else "case", "dashed") for g in set(goals)]
            else:
                edges += [(i, g, "case", "dashed") for g in goals]
            edges.append((i, to[-1][1], "default", "dashed"))
        elif r["kind"] == "jump":
            edges.append((i, to[0][1], "" if r["op"] == "goto" else "true", "solid" if r["op"] == "goto" else "dashed"))
            edges += [(i, i + 1, "false", "dashed")] * (r["op"] != "goto" and i + 1 < len(blocks))
        elif r["op"] not in flow.ENDS and i + 1 < len(blocks):
            edges.append((i, i + 1, "", "solid"))
        edges += [(i, block[at[h["handler"]]], (h["type"] or "any").rpartition("/")[2], "dotted") for h in handlers if rows[blocks[i][0]]["offset"] <= h["end"] and r["offset"] >= h["start"]]
    return blocks, sorted(edges)


def test_control_flow(decoded):
    rows, handlers = bytecode.instructions(decoded), bytecode.handlers(decoded)
    blocks = flow.basic_blocks(rows, handlers).cache()
    edges = flow.flow_edges(blocks, handlers)
    got_blocks, got_edges = {}, {}
    for r in blocks.orderBy("block").collect():
        got_blocks.setdefault((r["full_path"], r["method_pos"]), []).append((r["first"], r["last"]))
    for r in edges.collect():
        got_edges.setdefault((r["full_path"], r["method_pos"]), []).append((r["src"], r["dst"], r["label"], r["style"]))
    assert len(got_blocks) == decoded.count()
    for r in decoded.collect():
        key = r["full_path"], r["method_pos"]
        want = plain_flow(r["instructions"], r["handlers"])
        assert (got_blocks[key], sorted(got_edges.get(key, []))) == want, r["method"]
    styles = {(x[2], x[3]) for v in got_edges.values() for x in v}
    assert {("2 cases", "dashed"), ("case", "dashed"), ("default", "dashed"), ("NullPointerException", "dotted"), ("any", "dotted"), ("true", "dashed"), ("", "solid")} <= styles
    assert flow.unreachable_blocks(blocks, edges).count() == 0


def test_bytecode_lines_are_searched_like_others(decoded):
    lines = bytecode.bytecode_lines(decoded).cache()
    n = {r["path"]: (r["n"], r["most"]) for r in lines.groupBy("path").agg(F.count("*").alias("n"), F.max("line_no").alias("most")).collect()}
    assert all(a == b for a, b in n.values())
    found = lines.where(F.col("path").endswith("Caller.class") & F.col("text").contains("putstatic"))
    assert found.first()["text"].endswith("putstatic com/example/Target.value : I")
    hits = search.bytecode_hits(lines, "PUTSTATIC com/example/Target").collect()
    assert [(r["full_path"], r["match_line"].split(" ", 1)[1], r["match_type"]) for r in hits] == [("com/example/Caller.class", "putstatic com/example/Target.value : I", "BYTECODE")]
    assert search.bytecode_hits(lines, "putstatic com/example/Target", case_sensitive=True).count() == 1 and search.bytecode_hits(lines, " ").count() == 0


def test_basic_blocks_gather_no_rows_of_a_block(spark):
    made = [("m", 0, 0, "nop", "plain"), ("m", 1, 3, "ifeq", "jump"), ("m", 2, 6, "nop", "plain"), ("m", 3, 7, "ireturn", "plain")]
    code = spark.createDataFrame(made, "m string, at int, offset int, op string, kind string").selectExpr("*", "if(kind = 'jump', array(named_struct('label', string(null), 'offset', 3)), array()) AS targets")
    blocks = flow.basic_blocks(code, by=["m"])
    got = [tuple(r) for r in blocks.select("block", "first", "last", "start", "end", "n", "op").orderBy("block").collect()]
    assert got == [(0, 0, 0, 0, 0, 1, "nop"), (1, 1, 1, 3, 3, 1, "ifeq"), (2, 2, 3, 6, 7, 2, "ireturn")]
    assert "max_by" not in blocks._jdf.queryExecution().optimizedPlan().toString()
