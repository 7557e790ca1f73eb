"""Generic signatures as trees: a recursive descent over the grammar of the class-file format, one array of nodes a row.

A node is (id, parent, role, kind, name, dims, wildcard, start, end): ids number the nodes of a signature in preorder, and start and
end are its place in the text, so the text of any part is a substring. Roles are type_parameter, class_bound, interface_bound,
superclass, interface, parameter, result, throws, field, argument and inner (a nested class of the class before it). Kinds are base,
class, variable, parameter (of type parameters) and any (an unbounded wildcard); dims are those of arrays, wildcard is ``+`` or ``-``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BASE = re.compile("[BCDFIJSZV]")
NAME = re.compile(r"[^.;\[/<>:()^]+(?:/[^.;\[/<>:()^]+)*")
IDENTIFIER = re.compile(r"[^.;\[/<>:()^]+")
#: Nested types deeper than this are an error of their row.
DEEPEST = 200
NODE = pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("dims", pa.int32()), ("wildcard", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
NODE_DDL = "struct<id:int,parent:int,role:string,kind:string,name:string,dims:int,wildcard:string,start:int,end:int>"


class Signature:
    """A cursor over one signature that collects its nodes; ValueError where the text isn't one."""

    def __init__(self, text: str):
        self.text, self.at, self.nodes, self.depth = text, 0, [], 0

    def ahead(self, sign: str) -> bool:
        return self.text.startswith(sign, self.at)

    def take(self, pattern: re.Pattern | str) -> str:
        found = self.text[self.at : self.at + len(pattern)] if isinstance(pattern, str) and self.ahead(pattern) else None
        if not isinstance(pattern, str) and (m := pattern.match(self.text, self.at)):
            found = m[0]
        if not found:
            raise ValueError(f"{self.at}: {self.text[self.at : self.at + 1] or 'end'}")
        self.at += len(found)
        return found

    def node(self, parent: int | None, role: str, kind: str, **more) -> dict:
        out = {"id": len(self.nodes), "parent": parent, "role": role, "kind": kind, "name": None, "dims": 0, "wildcard": None, "start": self.at, "end": self.at, **more}
        self.nodes.append(out)
        return out

    def type(self, parent: int | None, role: str, wildcard: str | None = None, void: bool = False) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            raise ValueError("too deep")
        start = self.at - bool(wildcard)
        while self.ahead("["):
            self.take("[")
        dims = self.at - start - bool(wildcard)
        if self.ahead("T"):
            own = self.node(parent, role, "variable", dims=dims, wildcard=wildcard, start=start)
            self.take("T")
            own["name"] = self.take(IDENTIFIER)
            self.take(";")
        elif self.ahead("L"):
            own = self.node(parent, role, "class", dims=dims, wildcard=wildcard, start=start)
            self.take("L")
            own["name"] = self.take(NAME)
            self.arguments(own["id"])
            outer = own
            while self.ahead("."):
                inner = self.node(outer["id"], "inner", "class", start=self.at)
                self.take(".")
                inner["name"] = self.take(IDENTIFIER)
                self.arguments(inner["id"])
                inner["end"], outer = self.at, inner
            self.take(";")
        else:
            own = self.node(parent, role, "base", dims=dims, start=start)
            own["name"] = self.take(BASE)
            if own["name"] == "V" and (dims or not void):
                raise ValueError(f"{start}: void")
            if wildcard or role == "argument" and not dims:
                raise ValueError(f"{start}: primitive argument")
        own["end"] = self.at
        self.depth -= 1

    def arguments(self, parent: int) -> None:
        if self.ahead("<"):
            self.take("<")
            while not self.ahead(">"):
                if self.ahead("*"):
                    own = self.node(parent, "argument", "any")
                    self.take("*")
                    own["end"] = self.at
                elif self.ahead("+") or self.ahead("-"):
                    self.type(parent, "argument", self.take("+" if self.ahead("+") else "-"))
                else:
                    self.type(parent, "argument")
            if self.nodes[-1]["id"] == parent:
                raise ValueError(f"{self.at}: no argument")
            self.take(">")

    def type_parameters(self) -> None:
        if self.ahead("<"):
            self.take("<")
            while not self.ahead(">"):
                own = self.node(None, "type_parameter", "parameter")
                own["name"] = self.take(IDENTIFIER)
                self.take(":")
                if not self.ahead(":") and not self.ahead(">") and self.text[self.at : self.at + 1] in ("L", "T", "["):
                    self.type(own["id"], "class_bound")
                while self.ahead(":"):
                    self.take(":")
                    self.type(own["id"], "interface_bound")
                own["end"] = self.at
            self.take(">")

    def read(self, kind: str) -> list[dict]:
        if kind == "field":
            self.type(None, "field")
        else:
            self.type_parameters()
            if kind == "class":
                self.type(None, "superclass")
                while self.at < len(self.text):
                    self.type(None, "interface")
            else:
                self.take("(")
                while not self.ahead(")"):
                    self.type(None, "parameter")
                self.take(")")
                self.type(None, "result", void=True)
                while self.ahead("^"):
                    self.take("^")
                    self.type(None, "throws")
        if self.at < len(self.text):
            raise ValueError(f"{self.at}: {self.text[self.at]}")
        return self.nodes


def with_nodes(df: DataFrame, column: str, kind: str, nodes: str = "nodes", error: str = "error") -> DataFrame:
    """``df`` with the nodes of the signatures or descriptors in ``column`` and, where they are malformed, null nodes and an error.

    kind is class, method or field. Null texts have neither nodes nor an error.
    """
    if kind not in ("class", "method", "field"):
        raise ValueError(kind)
    rest = [c for c in df.columns if c not in (nodes, error)]
    at = rest.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for text in batch.column(at).to_pylist():
                try:
                    found.append(None if text is None else Signature(text).read(kind))
                    errors.append(None)
                except ValueError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(NODE)), pa.array(errors, pa.string())], names=[*rest, nodes, error])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*(f"`{c}`" for c in rest)).mapInArrow(run, f"{kinds}, `{nodes}` array<{NODE_DDL}>, `{error}` string")


def parts_of(text: Column, nodes: Column, role: str) -> Column:
    """The texts of the nodes with a role that stand at the top, in order; null where there are no nodes."""
    own = F.filter(nodes, lambda n: (n["role"] == role) & n["parent"].isNull())
    return F.transform(own, lambda n: F.substring(text, n["start"] + 1, n["end"] - n["start"]))


def classes_named(nodes: Column) -> Column:
    """The distinct classes that a signature names at any depth; nested classes are joined to theirs by ``$``."""
    # An inner class has its parent before it: names are put together in the order of ids.
    full = F.aggregate(
        nodes, F.create_map().cast("map<int,string>"),
        lambda known, n: F.when(n["kind"] == "class", F.map_concat(known, F.create_map(n["id"], F.when(n["role"] == "inner", F.concat_ws("$", F.element_at(known, n["parent"]), n["name"])).otherwise(n["name"])))).otherwise(known),
    )
    return F.array_sort(F.array_distinct(F.map_values(full)))
