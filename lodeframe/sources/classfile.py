"""Class files as tables: classes, methods, fields, annotations, references and edges.

One pass in Arrow batches turns each class file into a row with nested lists; the tables are projections of it.
What isn't a class file gives no row in the tables and one in ``rejected``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeframe.functions.predicates import INTERFACE
from lodeframe.functions.signatures import parts_of, with_nodes
from lodeframe.plans.scratch import materialize

OBJECT = "java/lang/Object"
#: An inner class that record classes name without need.
LOOKUP = ("java/lang/invoke/MethodHandles$Lookup", "java/lang/invoke/MethodHandles")
#: Fixed values of the class-file format: bytes after the tag of a constant, and the layout of numbers.
CONSTANT_BYTES = {7: 2, 8: 2, 16: 2, 19: 2, 20: 2, 9: 4, 10: 4, 11: 4, 12: 4, 17: 4, 18: 4, 15: 3}
NUMBERS = {3: ">i", 4: ">f", 5: ">q", 6: ">d"}

ANNOTATION = pa.struct([("annotation", pa.string()), ("params", pa.string())])
PARAMETER_ANNOTATION = pa.struct([("parameter", pa.int32()), ("annotation", pa.string()), ("params", pa.string())])
PARAMETER = pa.struct([("name", pa.string()), ("modifiers", pa.int32())])
FIELD = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("descriptor", pa.string()), ("signature", pa.string()), ("modifiers", pa.int32()),
                   ("constant_value", pa.string()), ("annotations", pa.list_(ANNOTATION))])
METHOD = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("descriptor", pa.string()), ("signature", pa.string()), ("modifiers", pa.int32()),
                    ("throws", pa.list_(pa.string())), ("has_body", pa.bool_()), ("annotations", pa.list_(ANNOTATION)), ("parameter_annotations", pa.list_(PARAMETER_ANNOTATION)), ("annotated_parameters", pa.int32()),
                    ("parameters", pa.list_(PARAMETER))])
CONTAINMENT = pa.struct([("inner", pa.string()), ("outer", pa.string())])
PARSED = pa.schema([
    ("full_path", pa.string()), ("error", pa.string()), ("name", pa.string()), ("modifiers", pa.int32()), ("superclass", pa.string()),
    ("interfaces", pa.list_(pa.string())), ("major_version", pa.int32()), ("is_record", pa.bool_()), ("source_file", pa.string()),
    ("signature", pa.string()), ("annotations", pa.list_(ANNOTATION)), ("fields", pa.list_(FIELD)), ("methods", pa.list_(METHOD)), ("refs", pa.list_(pa.string())),
    ("containment", pa.list_(CONTAINMENT)), ("enclosing_method", pa.string()),
])
_NOTE = "array<struct<annotation:string,params:string>>"
PARSED_DDL = (
    "full_path string, error string, name string, modifiers int, superclass string, interfaces array<string>, major_version int, is_record boolean, "
    f"source_file string, signature string, annotations {_NOTE}, "
    f"fields array<struct<pos:int,name:string,descriptor:string,signature:string,modifiers:int,constant_value:string,annotations:{_NOTE}>>, "
    f"methods array<struct<pos:int,name:string,descriptor:string,signature:string,modifiers:int,throws:array<string>,has_body:boolean,annotations:{_NOTE},"
    "parameter_annotations:array<struct<parameter:int,annotation:string,params:string>>,annotated_parameters:int,parameters:array<struct<name:string,modifiers:int>>>>, "
    "refs array<string>, containment array<struct<inner:string,outer:string>>, enclosing_method string"
)


class _Bytes:
    """A cursor over big-endian bytes that fails at the end of them."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("truncated")
        self.at += n
        return out

    def uint(self, n: int = 2) -> int:
        return int.from_bytes(self.take(n), "big")


def _text(raw: bytes) -> str:
    """Modified UTF-8: a two-byte zero, and pairs of surrogates."""
    s = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _constants(b: _Bytes) -> list:
    pool, n = [None], b.uint()
    while len(pool) < n:
        tag = b.uint(1)
        if tag == 1:
            pool.append((tag, _text(b.take(b.uint()))))
        elif tag in NUMBERS:
            pool.append((tag, struct.unpack(NUMBERS[tag], b.take(struct.calcsize(NUMBERS[tag])))[0]))
            if tag in (5, 6):
                pool.append(None)
        elif tag in CONSTANT_BYTES:
            pool.append((tag, int.from_bytes(b.take(CONSTANT_BYTES[tag]), "big")))
        else:
            raise ValueError(f"constant tag {tag}")
    return pool


class Pool:
    """The constants of a class file. Called with an index it gives a value, of classes and strings their text."""

    def __init__(self, b: _Bytes) -> None:
        self.items = _constants(b)

    def __call__(self, i: int):
        if not 0 < i < len(self.items) or self.items[i] is None:
            raise ValueError(f"constant index {i}")
        tag, v = self.items[i]
        return self(v) if tag in (7, 8, 16, 19, 20) else v

    def pair(self, i: int, *tags: int, split: int = 16) -> tuple[int, int]:
        """The two halves of a constant of one of the ``tags``."""
        if not 0 < i < len(self.items) or self.items[i] is None or self.items[i][0] not in tags:
            raise ValueError(f"constant index {i}")
        v = self.items[i][1]
        return v >> split, v & ((1 << split) - 1)

    def name_and_type(self, i: int) -> tuple[str, str]:
        name, descriptor = self.pair(i, 12)
        return self(name), self(descriptor)

    def member(self, i: int) -> tuple[str, str, str]:
        """Owner, name and descriptor of a field or method reference."""
        owner, rest = self.pair(i, 9, 10, 11)
        return (self(owner), *self.name_and_type(rest))


def read_class(data: bytes) -> tuple[dict, Pool, list[tuple[int, bytes]], dict]:
    """The columns of ``PARSED`` after error, the constants, (position, Code attribute) of methods with a body, and the class's
    attributes; ValueError for what isn't a class file."""
    b = _Bytes(data)
    if b.uint(4) != 0xCAFEBABE:
        raise ValueError("no class file")
    b.take(2)
    major, pool = b.uint(), Pool(b)
    const = pool

    def value(r: _Bytes):
        tag = chr(r.uint(1))
        if tag == "e":
            return f"{const(r.uint())}.{const(r.uint())}"
        if tag == "@":
            return note(r)
        if tag == "[":
            return [value(r) for _ in range(r.uint())]
        v = const(r.uint())
        return bool(v) if tag == "Z" else chr(v) if tag == "C" else v

    def note(r: _Bytes) -> dict:
        kind = const(r.uint())
        return {"annotation": kind[1:-1], "params": json.dumps({const(r.uint()): value(r) for _ in range(r.uint())}, default=str, sort_keys=True)}

    def attributes() -> dict:
        out = {}
        for _ in range(b.uint()):
            name = const(b.uint())
            out[name] = b.take(b.uint(4))
        return out

    def notes(attrs: dict) -> list:
        found = []
        for name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            if name in attrs:
                r = _Bytes(attrs[name])
                found += [note(r) for _ in range(r.uint())]
        return found

    def parameter_notes(attrs: dict) -> list:
        found = []
        for name in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
            if name in attrs:
                r = _Bytes(attrs[name])
                found += [{"parameter": p, **note(r)} for p in range(r.uint(1)) for _ in range(r.uint())]
        return found

    def annotated(attrs: dict) -> int:
        """For how many parameters there are lists of annotations, empty ones included."""
        return max((attrs[n][0] for n in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations") if attrs.get(n)), default=0)

    def parameters(attrs: dict) -> list:
        """Names (null if there is none) and modifiers, where the compiler has kept them."""
        r = _Bytes(attrs.get("MethodParameters", b"\0"))
        return [{"name": const(i) if (i := r.uint()) else None, "modifiers": r.uint()} for _ in range(r.uint(1))]

    def containment(attrs: dict) -> tuple[list, str | None]:
        """(inner, outer) of all classes that the file tells of, and the method around this class, if it is local or anonymous."""
        found, method = [], None
        if "InnerClasses" in attrs:
            r = _Bytes(attrs["InnerClasses"])
            for _ in range(r.uint()):
                inner, outer = r.uint(), r.uint()
                r.take(4)
                if inner and outer:
                    found.append((const(inner), const(outer)))
            if any(x == y for x, y in found):
                raise ValueError("class inside itself")
        if "EnclosingMethod" in attrs:
            r = _Bytes(attrs["EnclosingMethod"])
            outer, at = const(r.uint()), r.uint()
            found.append((name, outer))
            method = f"{outer}.{const(const(at) >> 16) if at else '<clinit>'}"
        return [{"inner": x, "outer": y} for x, y in dict.fromkeys(found) if (x, y) != LOOKUP], method

    def utf(attrs: dict, name: str):
        return const(_Bytes(attrs[name]).uint()) if name in attrs else None

    modifiers, name = b.uint(), const(b.uint())
    above = b.uint()
    interfaces = [const(b.uint()) for _ in range(b.uint())]

    def members() -> list:
        out = []
        for pos in range(b.uint()):
            m = {"pos": pos, "modifiers": b.uint(), "name": const(b.uint()), "descriptor": const(b.uint())}
            attrs = attributes()
            constant = utf(attrs, "ConstantValue")
            throws = _Bytes(attrs["Exceptions"]) if "Exceptions" in attrs else None
            m |= {"signature": utf(attrs, "Signature"), "annotations": notes(attrs), "parameter_annotations": parameter_notes(attrs), "annotated_parameters": annotated(attrs), "parameters": parameters(attrs), "constant_value": None if constant is None else str(constant)}
            if "Code" in attrs:
                codes.append((pos, attrs["Code"]))
            m |= {"has_body": "Code" in attrs, "throws": [const(throws.uint()) for _ in range(throws.uint())] if throws else []}
            out.append(m)
        return out

    codes: list[tuple[int, bytes]] = []
    fields = members()
    codes.clear()
    methods = members()
    attrs = attributes()
    inside, around = containment(attrs)
    classes = [const(i) for i, c in enumerate(pool.items) if c and c[0] == 7]
    refs = dict.fromkeys(c for c in classes if not c.startswith("["))
    row = {
        "name": name, "modifiers": modifiers, "superclass": const(above) if above else None, "interfaces": interfaces, "major_version": major,
        "is_record": "Record" in attrs, "source_file": utf(attrs, "SourceFile"), "signature": utf(attrs, "Signature"),
        "annotations": notes(attrs), "fields": fields, "methods": methods, "refs": list(refs), "containment": inside, "enclosing_method": around,
    }
    return row, pool, codes, attrs


def parse_class(data: bytes) -> dict:
    """The columns of ``PARSED`` after error; ValueError for what isn't a class file."""
    return read_class(data)[0]


def parse_classes(entries: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row (``PARSED``) per entry; error is set, and all else null, where the bytes aren't a class file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append({"full_path": p, **parse_class(data or b"")})
                except (ValueError, TypeError, AttributeError, RecursionError, struct.error) as e:
                    rows.append({"full_path": p, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, PARSED)

    return entries.select(F.col(path).cast("string"), F.col(content)).mapInArrow(run, PARSED_DDL)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("full_path", "error")


def classes(parsed: DataFrame) -> DataFrame:
    """Scanned classes, and a stub for each superclass or interface that was referred to but not scanned."""
    own = parsed.where("error is null").select("name", "modifiers", "superclass", "interfaces", "major_version", "is_record", "source_file", "signature", "enclosing_method", "full_path", F.lit(False).alias("is_external"))
    ups = edges(parsed).where("rel IN ('extends', 'implements')").groupBy(F.col("dst").alias("name")).agg(F.bool_or(F.col("rel") == "implements").alias("i"))
    stubs = ups.join(own, "name", "left_anti").select(
        "name", F.when(F.col("i"), INTERFACE).otherwise(0).alias("modifiers"), F.array().cast("array<string>").alias("interfaces"),
        F.lit(False).alias("is_record"), F.lit(True).alias("is_external"),
    )
    return own.unionByName(stubs, allowMissingColumns=True)


def _members(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.where("error is null").select(F.col("name").alias("owner"), F.explode(column).alias("m")).select("owner", "m.*").drop("annotations", "parameter_annotations", "annotated_parameters", "parameters")


def fields(parsed: DataFrame) -> DataFrame:
    return _members(parsed, "fields")


def methods(parsed: DataFrame) -> DataFrame:
    return _members(parsed, "methods")


def method_parameters(parsed: DataFrame) -> DataFrame:
    """(owner, name, method_desc, position, descriptor, signature, parameter, modifiers, annotations) of every parameter of every method.

    Lists of types, generic types, names, modifiers and annotations of one method may differ in length, as compilers put parameters
    of their own in front. All are aligned at the last parameter; what a shorter list lacks is null.
    """
    whole = with_nodes(parsed.where("error is null").select(F.col("name").alias("owner"), F.explode("methods").alias("m")).select("owner", "m.*"), "signature", "method")
    types = F.regexp_extract_all(F.regexp_extract("descriptor", r"^\((.*)\)", 1), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]*;)"), F.lit(0))
    generic = F.coalesce(parts_of(F.col("signature"), F.col("nodes"), "parameter"), F.array().cast("array<string>"))
    marks = F.transform(F.sequence(F.lit(1), F.col("annotated_parameters")), lambda i: F.transform(F.filter("parameter_annotations", lambda a: a["parameter"] == i - 1), lambda a: a["annotation"]))
    marks = F.when(F.col("annotated_parameters") > 0, marks).otherwise(F.array().cast("array<array<string>>"))
    lists = whole.select("owner", "name", F.col("descriptor").alias("method_desc"), types.alias("descriptor"), generic.alias("signature"), F.transform("parameters", lambda p: p["name"]).alias("parameter"),
                         F.transform("parameters", lambda p: p["modifiers"]).alias("modifiers"), marks.alias("annotations"))
    columns = ("descriptor", "signature", "parameter", "modifiers", "annotations")
    n = F.greatest(*(F.size(c) for c in columns))
    lacking = lambda c: F.array_repeat(F.lit(None).cast(lists.schema[c].dataType.elementType), n - F.size(c))
    aligned = lists.select("owner", "name", "method_desc", *(F.concat(lacking(c), F.col(c)).alias(c) for c in columns))
    return aligned.select("owner", "name", "method_desc", F.posexplode(F.arrays_zip(*columns)).alias("position", "p")).select("owner", "name", "method_desc", "position", "p.*")


def annotations(parsed: DataFrame) -> DataFrame:
    """(target_kind, owner, member, annotation, params): params is a JSON object; of a parameter, member ends in ``#`` and its position."""
    ok = parsed.where("error is null")

    def of(kind: str, column: str) -> DataFrame:
        m = ok.select(F.col("name").alias("owner"), F.explode(column).alias("m"))
        return m.select(F.lit(kind).alias("target_kind"), "owner", F.concat("m.name", "m.descriptor").alias("member"), F.explode("m.annotations").alias("a"))

    own = ok.select(F.lit("class").alias("target_kind"), F.col("name").alias("owner"), F.lit(None).cast("string").alias("member"), F.explode("annotations").alias("a"))
    whose = ok.select(F.col("name").alias("owner"), F.explode("methods").alias("m")).select("owner", "m.name", "m.descriptor", F.explode("m.parameter_annotations").alias("a"))
    of_parameters = whose.select(F.lit("parameter").alias("target_kind"), "owner", F.concat("name", "descriptor", F.lit("#"), F.col("a.parameter").cast("string")).alias("member"),
                                 F.struct("a.annotation", "a.params").alias("a"))
    return own.unionByName(of("field", "fields")).unionByName(of("method", "methods")).unionByName(of_parameters).select("target_kind", "owner", "member", "a.*")


def edges(parsed: DataFrame) -> DataFrame:
    """(rel, src, dst): extends (but not of the root class), implements, annotated, references and, once each, outer (from inner classes)."""
    ok = parsed.where("error is null")

    def of(rel: str, targets) -> DataFrame:
        return ok.select(F.lit(rel).alias("rel"), F.col("name").alias("src"), F.explode(targets).alias("dst"))

    ups = of("extends", F.array("superclass")).where(F.col("dst").isNotNull() & (F.col("dst") != OBJECT))
    outer = ok.select(F.explode("containment").alias("c")).select(F.lit("outer").alias("rel"), F.col("c.inner").alias("src"), F.col("c.outer").alias("dst")).distinct()
    refs = of("references", F.array_except("refs", F.array("name")))
    return ups.unionByName(of("implements", "interfaces")).unionByName(of("annotated", F.transform("annotations", lambda a: a["annotation"]))).unionByName(refs).unionByName(outer)


def named_above(parsed: DataFrame) -> DataFrame:
    """Distinct (name) of the superclasses, interfaces, annotations and thrown exceptions that classes name, and of the classes around them."""
    ok = parsed.where("error is null")
    ups = ok.select(F.explode(F.array_compact(F.concat(F.array("superclass"), "interfaces"))).alias("name"))
    thrown = ok.select(F.explode("methods").alias("m")).select(F.explode("m.throws"))
    around = ok.select("name", F.explode("containment").alias("c")).where("c.inner = name").select("c.outer")
    return ups.union(around).union(annotations(parsed).select("annotation")).union(thrown).where("name is not null").distinct()


def extend_upwards(parsed: DataFrame, entries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``parsed`` and, until nothing is new, the classes of ``entries`` that those found so far name above them.

    ``excluded`` (name) are classes that are never added. Names without an entry are left out; of several entries
    with one path all are read, so pass masked ones. A round reads only the entries that it adds.
    """
    parts = [materialize(parsed, "parsed")]
    met = [parts[0].select("name")] + ([] if excluded is None else [excluded.select("name")])
    while True:
        known = reduce(DataFrame.unionByName, met).where("name is not null").distinct()
        wanted = materialize(named_above(parts[-1]).join(known, "name", "left_anti"), "wanted")
        if wanted.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        paths = wanted.select(F.concat(F.translate("name", ".", "/"), F.lit(".class")).alias("path"))
        parts.append(materialize(parse_classes(entries.join(paths, "path", "left_semi")), "parsed"))
        met.append(wanted)
