"""Columns that compare texts; lengths are UTF-16 units. A null operand gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def units(text: Column) -> Column:
    """The UTF-16 units of a text, as hex digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(r"[0-9A-F]{4}"), F.lit(0))


def _shared(a: Column, b: Column) -> Column:
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.when(first_other == 0, F.size(a).cast("long")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    return _shared(units(a), units(b))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    return _shared(F.reverse(units(a)), F.reverse(units(b)))


def diff_distance(diffs: Column) -> Column:
    """Edit distance of a diff, an array of structs (operation, text) with operations INSERT, DELETE and EQUAL.

    Between two EQUAL pieces the larger one of the inserted and the deleted length counts, so a replaced unit is one
    edit. This is no smaller than the distance of the texts.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("done"), zero.alias("added"), zero.alias("gone"))

    def step(s: Column, d: Column) -> Column:
        n = (F.octet_length(F.encode(d["text"], "UTF-16BE")) / 2).cast("long")
        end = d["operation"] == "EQUAL"
        return F.struct(
            F.when(end, s["done"] + F.greatest(s["added"], s["gone"])).otherwise(s["done"]).alias("done"),
            F.when(end, zero).when(d["operation"] == "INSERT", s["added"] + n).otherwise(s["added"]).alias("added"),
            F.when(end, zero).when(d["operation"] == "DELETE", s["gone"] + n).otherwise(s["gone"]).alias("gone"),
        )

    return F.aggregate(diffs, start, step, lambda s: s["done"] + F.greatest(s["added"], s["gone"]))
