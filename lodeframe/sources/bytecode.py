"""Instructions of method bodies as tables.

One pass in Arrow batches decodes every Code attribute of a class file into a row per method, with nested lists of at most the
65,535 bytes that the format allows; instructions, exception handlers and local variables are projections of it.
Entries that aren't class files have no row (``classfile.rejected`` lists them); a method whose code is malformed has
a row with an error, and no instructions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodeframe.sources.classfile import Pool, _Bytes, read_class


def mnemonics() -> list[str]:
    """The names of opcodes 0 to 201, in the order of the instruction set; families of names are spelt by their rule."""
    kinds, arrays = "ilfda", [*"ilfda", *"bcs"]
    out = ["nop", "aconst_null", "iconst_m1", *(f"iconst_{i}" for i in range(6)), "lconst_0", "lconst_1", *(f"fconst_{i}" for i in range(3)), "dconst_0", "dconst_1"]
    out += ["bipush", "sipush", "ldc", "ldc_w", "ldc2_w"]
    for verb in ("load", "store"):
        out += [f"{k}{verb}" for k in kinds] + [f"{k}{verb}_{i}" for k in kinds for i in range(4)] + [f"{k}a{verb}" for k in arrays]
    out += ["pop", "pop2", "dup", "dup_x1", "dup_x2", "dup2", "dup2_x1", "dup2_x2", "swap"]
    out += [f"{k}{verb}" for verb in ("add", "sub", "mul", "div", "rem", "neg") for k in "ilfd"]
    out += [f"{k}{verb}" for verb in ("shl", "shr", "ushr", "and", "or", "xor") for k in "il"]
    out += ["iinc", *(f"{a}2{b}" for a in "ilfd" for b in "ilfd" if a != b), "i2b", "i2c", "i2s"]
    out += ["lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg"]
    tests = ("eq", "ne", "lt", "ge", "gt", "le")
    out += [*(f"if{t}" for t in tests), *(f"if_icmp{t}" for t in tests), "if_acmpeq", "if_acmpne", "goto", "jsr", "ret", "tableswitch", "lookupswitch"]
    out += [*(f"{k}return" for k in kinds), "return", "getstatic", "putstatic", "getfield", "putfield"]
    out += ["invokevirtual", "invokespecial", "invokestatic", "invokeinterface", "invokedynamic", "new", "newarray", "anewarray", "arraylength", "athrow"]
    return out + ["checkcast", "instanceof", "monitorenter", "monitorexit", "wide", "multianewarray", "ifnull", "ifnonnull", "goto_w", "jsr_w"]


OPS = mnemonics()
CODE = {op: i for i, op in enumerate(OPS)}
LOCALS = {f"{k}{verb}" for k in "ilfda" for verb in ("load", "store")} | {"ret"}
JUMPS = {op for op in OPS if op.startswith("if")} | {"goto", "jsr"}
FIELDS = {"getstatic", "putstatic", "getfield", "putfield"}
CALLS = {"invokevirtual", "invokespecial", "invokestatic", "invokeinterface"}
TYPES = {"new", "anewarray", "checkcast", "instanceof"}
RETURNS = {f"{k}return" for k in "ilfda"} | {"return"}
#: Fixed values of the format: element types of newarray, from 4 on, and the kinds of method handles, from 1 on.
ELEMENTS = ("boolean", "char", "float", "double", "byte", "short", "int", "long")
HANDLES = ("getfield", "getstatic", "putfield", "putstatic", "invokevirtual", "invokestatic", "invokespecial", "newinvokespecial", "invokeinterface")

TARGET = pa.struct([("label", pa.string()), ("offset", pa.int32())])
HANDLE = pa.struct([("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("descriptor", pa.string())])
INSTRUCTION = pa.struct([
    ("at", pa.int32()), ("offset", pa.int32()), ("op", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()),
    ("descriptor", pa.string()), ("value", pa.string()), ("targets", pa.list_(TARGET)), ("handles", pa.list_(HANDLE)), ("types", pa.list_(pa.string())),
])
HANDLER = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("handler", pa.int32()), ("type", pa.string())])
LOCAL = pa.struct([("slot", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("name", pa.string()), ("descriptor", pa.string())])
DECODED = pa.schema([
    ("full_path", pa.string()), ("class_name", pa.string()), ("method_pos", pa.int32()), ("method", pa.string()), ("method_desc", pa.string()), ("modifiers", pa.int32()), ("error", pa.string()),
    ("max_stack", pa.int32()), ("max_locals", pa.int32()), ("code_length", pa.int32()), ("instructions", pa.list_(INSTRUCTION)), ("handlers", pa.list_(HANDLER)), ("locals", pa.list_(LOCAL)),
])
_HANDLES_DDL = "array<struct<kind:string,owner:string,name:string,descriptor:string>>"
DECODED_DDL = (
    "full_path string, class_name string, method_pos int, method string, method_desc string, modifiers int, error string, max_stack int, max_locals int, code_length int, "
    "instructions array<struct<at:int,offset:int,op:string,line:int,kind:string,owner:string,name:string,descriptor:string,value:string,"
    f"targets:array<struct<label:string,offset:int>>,handles:{_HANDLES_DDL},types:array<string>>>, "
    "handlers array<struct<start:int,end:int,handler:int,type:string>>, locals array<struct<slot:int,start:int,length:int,name:string,descriptor:string>>"
)


def element_name(descriptor: str) -> str | None:
    """The class at the bottom of an array type or descriptor; None for primitives."""
    bare = descriptor.lstrip("[")
    if bare.startswith("L") and bare.endswith(";"):
        return bare[1:-1]
    return bare if bare == descriptor else None


class Body:
    """The decoder of one Code attribute."""

    def __init__(self, raw: bytes, pool: Pool, bootstraps: list[tuple[int, list[int]]]):
        self.pool, self.bootstraps = pool, bootstraps
        b = _Bytes(raw)
        self.max_stack, self.max_locals = b.uint(), b.uint()
        self.code = b.take(b.uint(4))
        self.handlers = []
        for _ in range(b.uint()):
            start, end, handler, kind = b.uint(), b.uint(), b.uint(), b.uint()
            self.handlers.append({"start": start, "end": end, "handler": handler, "type": pool(kind) if kind else None})
        lines, self.locals = [], []
        for _ in range(b.uint()):
            name, r = pool(b.uint()), _Bytes(b.take(b.uint(4)))
            if name == "LineNumberTable":
                lines += [(r.uint(), r.uint()) for _ in range(r.uint())]
            elif name == "LocalVariableTable":
                for _ in range(r.uint()):
                    start, length, label, kind, slot = (r.uint() for _ in range(5))
                    self.locals.append({"slot": slot, "start": start, "length": length, "name": pool(label), "descriptor": pool(kind)})
        #: The line that holds from an offset on; of several for one offset the last.
        self.lines = dict(sorted(lines, key=lambda x: x[0]))

    def handle(self, index: int) -> dict:
        kind, ref = self.pool.pair(index, 15, split=16)
        owner, name, descriptor = self.pool.member(ref)
        return {"kind": HANDLES[kind - 1], "owner": owner, "name": name, "descriptor": descriptor}

    def constant(self, index: int) -> dict:
        """What ldc or a bootstrap argument holds."""
        tag, value = self.pool.items[index]
        if tag == 7:
            return {"kind": "class", "owner": element_name(self.pool(index)), "descriptor": self.pool(index)}
        if tag == 15:
            return {"kind": "handle", "handles": [self.handle(index)]}
        if tag == 16:
            return {"kind": "method_type", "descriptor": self.pool(index)}
        if tag == 17:
            return {"kind": "dynamic", **self.dynamic(index)}
        return {"kind": "string" if tag == 8 else "number", "value": str(self.pool(index))}

    def dynamic(self, index: int) -> dict:
        """Name, descriptor, and all handles and types of the bootstrap method and its arguments."""
        which, pair = self.pool.pair(index, 17, 18, split=16)
        name, descriptor = self.pool.name_and_type(pair)
        method, arguments = self.bootstraps[which]
        handles, types = [self.handle(method)], []
        for c in (self.constant(i) for i in arguments if self.pool.items[i][0] in (7, 15)):
            handles += c.get("handles", [])
            types += [c["owner"]] if c.get("owner") else []
        return {"name": name, "descriptor": descriptor, "handles": handles, "types": types}

    def instructions(self) -> list[dict]:
        b, out, line = _Bytes(self.code), [], 1
        while b.at < len(self.code):
            start = b.at
            line = max(1, self.lines[start]) if start in self.lines else line
            code = b.uint(1)
            if code >= len(OPS):
                raise ValueError(f"opcode {code}")
            row = {"at": len(out), "offset": start, "op": OPS[code], "line": line, "kind": "plain", **self.operands(OPS[code], b, start)}
            out.append(row)
        return out

    def operands(self, op: str, b: _Bytes, start: int) -> dict:
        signed = lambda n: int.from_bytes(b.take(n), "big", signed=True)
        jump = lambda n: {"kind": "jump", "targets": [{"label": None, "offset": start + signed(n)}]}
        if op in FIELDS or op in CALLS:
            owner, name, descriptor = self.pool.member(b.uint())
            if op == "invokeinterface":
                b.take(2)
            return {"kind": "field" if op in FIELDS else "call", "owner": owner, "name": name, "descriptor": descriptor}
        if op in TYPES:
            return {"kind": "type", "owner": self.pool(b.uint())}
        if op in ("ldc", "ldc_w", "ldc2_w"):
            return self.constant(b.uint(1 if op == "ldc" else 2))
        if op in JUMPS:
            return jump(2)
        if op in ("goto_w", "jsr_w"):
            return jump(4)
        if op in LOCALS:
            return {"value": str(b.uint(1))}
        if op == "iinc":
            return {"value": f"{b.uint(1)} {signed(1)}"}
        if op in ("bipush", "sipush"):
            return {"value": str(signed(1 if op == "bipush" else 2))}
        if op == "newarray":
            return {"value": ELEMENTS[b.uint(1) - 4]}
        if op == "invokedynamic":
            found = self.dynamic(b.uint())
            b.take(2)
            return {"kind": "dynamic", **found}
        if op == "multianewarray":
            descriptor = self.pool(b.uint())
            return {"kind": "type", "owner": element_name(descriptor), "descriptor": descriptor, "value": str(b.uint(1))}
        if op == "wide":
            inner = OPS[b.uint(1)]
            if inner == "iinc":
                return {"op": inner, "value": f"{b.uint()} {signed(2)}"}
            if inner not in LOCALS:
                raise ValueError(f"wide {inner}")
            return {"op": inner, "value": str(b.uint())}
        if op in ("tableswitch", "lookupswitch"):
            b.take(-b.at % 4)
            default = start + signed(4)
            if op == "tableswitch":
                low, high = signed(4), signed(4)
                if high - low > len(self.code):
                    raise ValueError("switch without end")
                cases = [(k, signed(4)) for k in range(low, high + 1)]
            else:
                cases = [(signed(4), signed(4)) for _ in range(b.uint(4))]
            return {"kind": "switch", "targets": [*({"label": str(k), "offset": start + o} for k, o in cases), {"label": "default", "offset": default}]}
        return {}


def bootstrap_methods(attrs: dict) -> list[tuple[int, list[int]]]:
    """(index of the handle, indices of the arguments) of the class's bootstrap methods."""
    if "BootstrapMethods" not in attrs:
        return []
    r = _Bytes(attrs["BootstrapMethods"])
    return [(r.uint(), [r.uint() for _ in range(r.uint())]) for _ in range(r.uint())]


def decode_class(data: bytes) -> list[dict]:
    """One row of ``DECODED``, but for the path, per method with a body."""
    found, pool, codes, attrs = read_class(data)
    bootstraps, out = bootstrap_methods(attrs), []
    for pos, raw in codes:
        m = found["methods"][pos]
        row = {"class_name": found["name"], "method_pos": pos, "method": m["name"], "method_desc": m["descriptor"], "modifiers": m["modifiers"]}
        try:
            body = Body(raw, pool, bootstraps)
            row |= {"max_stack": body.max_stack, "max_locals": body.max_locals, "code_length": len(body.code), "instructions": body.instructions(), "handlers": body.handlers, "locals": body.locals}
        except (ValueError, TypeError, IndexError, struct.error) as e:
            row["error"] = str(e) or type(e).__name__
        out.append(row)
    return out


def decode_bodies(entries: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row of ``DECODED`` per method with a body, of all entries that are class files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [{"full_path": p, **row} for row in decode_class(data or b"")]
                except (ValueError, TypeError, AttributeError, RecursionError, struct.error):
                    continue
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, DECODED)

    return entries.select(F.col(path).cast("string"), F.col(content)).mapInArrow(run, DECODED_DDL)


OWN = ("full_path", "class_name", "method_pos", "method", "method_desc")


def instructions(decoded: DataFrame) -> DataFrame:
    """A row per instruction: where it is, op, line (1 before the first known one), kind, and operands.

    kind is field, call, type, class (of ldc), dynamic, jump, switch, string, number, handle, method_type or plain; ``targets``
    are (label, offset) with the case, or ``default``, as label of switches.
    """
    return decoded.where("error is null").select(*OWN, F.explode("instructions").alias("i")).select(*OWN, "i.*")


def handlers(decoded: DataFrame) -> DataFrame:
    """A row per exception range: its place in the table, start, end (not included), handler and type (null: any)."""
    return decoded.where("error is null").select(*OWN, F.posexplode("handlers").alias("pos", "h")).select(*OWN, "pos", "h.*")


def local_variables(decoded: DataFrame) -> DataFrame:
    """A row per local variable range: slot, start, length, name and descriptor."""
    return decoded.where("error is null").select(*OWN, F.explode("locals").alias("l")).select(*OWN, "l.*")


def parameter_names(decoded: DataFrame) -> DataFrame:
    """(class, method, position from 0, name, descriptor) of parameters by the variables that hold from offset 0 on.

    Slots below the first parameter (``this``) and of later variables are no parameters; long and double take two slots.
    """
    flat = local_variables(decoded).where("start = 0").join(decoded.select("full_path", "method_pos", "modifiers"), ["full_path", "method_pos"])
    types = F.regexp_extract_all(F.regexp_extract("method_desc", r"^\((.*)\)", 1), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]*;)"), F.lit(0))
    # Slots that each parameter begins at: a running sum over at most 255 parameters.
    wide = F.transform(types, lambda t: F.when(t.isin("J", "D"), 2).otherwise(1))
    first = F.when(F.col("modifiers").bitwiseAND(8) > 0, 0).otherwise(1)
    begins = F.transform(types, lambda t, i: F.struct(i.alias("position"), (first + F.aggregate(F.slice(wide, F.lit(1), i), F.lit(0), lambda a, x: a + x)).alias("slot"), t.alias("descriptor")))
    found = flat.withColumn("p", F.explode(begins)).where((F.col("p.slot") == F.col("slot")) & (F.col("p.descriptor") == F.col("descriptor")))
    return found.select(*OWN, "p.position", "name", "descriptor")


def bytecode_lines(decoded: DataFrame) -> DataFrame:
    """(path, line_no, text): the code of each class as lines, a header for each method and a line per instruction."""
    i = instructions(decoded)
    goals = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["label"], t["offset"].cast("string"))), " ")
    member = F.concat_ws("", F.concat_ws(".", "owner", "name"), F.when(F.col("kind") == "field", F.concat(F.lit(" : "), "descriptor")).otherwise(F.col("descriptor")))
    operand = F.when(F.col("kind").isin("field", "call"), member).when(F.col("kind") == "dynamic", F.concat("name", "descriptor")).otherwise(F.coalesce("descriptor", "owner"))
    text = F.concat_ws(" ", F.concat(F.lit("  "), F.col("offset").cast("string"), F.lit(":")), "op", F.when(operand != "", operand), "value", F.when(goals != "", goals))
    body = i.select("full_path", "method_pos", F.col("at").alias("at"), text.alias("text"))
    head = decoded.where("error is null").select("full_path", "method_pos", F.lit(-1).alias("at"), F.concat("method", "method_desc").alias("text"))
    sized = decoded.where("error is null").select("full_path", "method_pos", (F.size("instructions") + 1).alias("n"))
    # A class has at most 65,535 methods: their lines before are a running sum over method rows, not over lines.
    before = F.sum("n").over(Window.partitionBy("full_path").orderBy("method_pos").rowsBetween(Window.unboundedPreceding, -1))
    base = sized.select("full_path", "method_pos", F.coalesce(before, F.lit(0)).alias("base"))
    return head.unionByName(body).join(base, ["full_path", "method_pos"]).select(F.col("full_path").alias("path"), (F.col("base") + F.col("at") + 2).cast("int").alias("line_no"), "text")
