"""Merged text search: providers of hits, exclusion, first-kept dedup, quotas, rank order and limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodeframe.functions.predicates import any_of, contains_glob, is_comment_line, java_trim, line_match
from lodeframe.operators.lines import lines
from lodeframe.plans.scratch import materialize

#: The most hits of one provider; the order of match types.
PROVIDER_CAP = 500
#: Ranges that one task sorts in a running total.
CELLS = 4096
#: Byte hits of one output batch.
HITS = 65_536
TYPES = ("CLASS", "METHOD", "FIELD", "CODE_TEXT", "COMMENT", "RESOURCE", "BYTECODE")
HIT = "full_path string, line_number int, match_line string, match_type string, type_ordinal int"


def text_hits(df: DataFrame, path: str, text: str, query: str, match_type: str = "CODE_TEXT", **options) -> DataFrame:
    """Hits of a line search over texts; the hit text is trimmed."""
    found = lines(df, path, text).where(line_match(F.col("line"), query, **options))
    return found.select("full_path", F.col("line_no").cast("int").alias("line_number"), java_trim(F.col("line")).alias("match_line"), F.lit(match_type).alias("match_type"), F.lit(TYPES.index(match_type)).alias("type_ordinal"))


def name_hits(df: DataFrame, path: str, name: str, query: str, match_type: str = "CLASS", **options) -> DataFrame:
    """Hits on names; the line is 1."""
    found = df.where(line_match(F.col(name), query, **options))
    return found.select(F.col(path).cast("string").alias("full_path"), F.lit(1).alias("line_number"), F.col(name).alias("match_line"), F.lit(match_type).alias("match_type"), F.lit(TYPES.index(match_type)).alias("type_ordinal"))


def comment_hits(df: DataFrame, path: str, text: str, query: str, **options) -> DataFrame:
    """Hits of a line search over the comment lines of texts."""
    own = lines(df, path, text).where(is_comment_line(F.col("line"))).withColumn("line", java_trim(F.col("line")))
    found = own.where(line_match(F.col("line"), query, **options))
    return found.select("full_path", F.col("line_no").cast("int").alias("line_number"), F.col("line").alias("match_line"), F.lit("COMMENT").alias("match_type"), F.lit(TYPES.index("COMMENT")).alias("type_ordinal"))


def bytecode_hits(code: DataFrame, query: str, **options) -> DataFrame:
    """Hits of a line search over lines of code (path, line_no, text), as ``sources.bytecode.bytecode_lines`` gives them."""
    found = code.where(line_match(F.col("text"), query, **options))
    return found.select(F.col("path").alias("full_path"), F.col("line_no").cast("int").alias("line_number"), java_trim(F.col("text")).alias("match_line"), F.lit("BYTECODE").alias("match_type"), F.lit(TYPES.index("BYTECODE")).alias("type_ordinal"))


def member_hits(members: DataFrame, path: str, query: str, match_type: str, **options) -> DataFrame:
    """Hits on names of methods or fields (owner, name, descriptor, pos); the hit is name and descriptor, its line the position."""
    found = members.where(line_match(F.col("name"), query, **options))
    return found.select(
        F.col(path).cast("string").alias("full_path"), (F.col("pos") + 1).cast("int").alias("line_number"), F.concat("name", F.lit(" "), "descriptor").alias("match_line"),
        F.lit(match_type).alias("match_type"), F.lit(TYPES.index(match_type)).alias("type_ordinal"),
    )


def in_scope(providers: dict[str, DataFrame], scope: str) -> list[DataFrame]:
    """The providers, named by match type, that a scope (ALL or a match type) runs."""
    return [df for kind, df in providers.items() if scope in ("ALL", kind)]


def quick_open(names: DataFrame, name: str, text: str) -> DataFrame:
    """``names`` that contain a text in either case; the empty text takes all."""
    return names.where(F.lower(name).contains(text.lower()))


def hex_bytes(query: str) -> bytes:
    """The bytes of hexadecimal digits, whatever stands between them; none where their number is odd."""
    digits = "".join(c for c in query if c in "0123456789abcdefABCDEF")
    return bytes.fromhex(digits) if len(digits) % 2 == 0 else b""


def byte_hits(df: DataFrame, path: str, content: str, needle: bytes) -> DataFrame:
    """(full_path, offset): every place, overlapping ones too, where the bytes of a binary column hold ``needle``."""

    def places(data: bytes) -> Iterator[int]:
        at = data.find(needle)
        while at >= 0:
            yield at
            at = data.find(needle, at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if needle else ():
            rows, found = [], []
            for i, data in enumerate(batch.column(1)):
                for at in places(data.as_py() or b""):
                    rows.append(i)
                    found.append(at)
                    if len(found) >= HITS:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(found, pa.int64())], names=["full_path", "offset"])
                        rows, found = [], []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(found, pa.int64())], names=["full_path", "offset"])

    return df.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "full_path string, offset long")


def merge_hits(providers: Sequence[DataFrame], limit: int, exclude: Sequence[str] = ()) -> DataFrame:
    """Hits of all providers by (type, line), then in the order of providers and paths, at most ``limit``.

    Each provider gives its first PROVIDER_CAP hits by path, line and text. Of these, excluded ones go, then those with
    the path, line and type of a hit that was taken already, and of the rest a provider gives max(1, 2 * limit /
    providers) at most and all together 2 * limit. The caps are top-k sorts, so no provider is gathered in one task; what
    follows sees PROVIDER_CAP rows a provider.
    """
    blank, most, order = [g for g in exclude if g.strip()], 2 * max(1, limit), ("full_path", "line_number", "match_line")
    key = ["full_path", "line_number", "match_type", "type_ordinal"]
    quota, left, taken = max(1, most // max(1, len(providers))), most, None
    for i, p in enumerate(providers):
        own = p.orderBy(*order).limit(PROVIDER_CAP)
        own = own.where(~any_of([contains_glob(F.col("full_path"), g) for g in blank])) if blank else own
        own = own.groupBy(*key).agg(F.min("match_line").alias("match_line"))
        own = own if taken is None else own.join(taken, key, "left_anti")
        # At most PROVIDER_CAP rows, which the next provider is compared with.
        own = materialize(own.orderBy(*order).limit(min(quota, left)).withColumn("provider", F.lit(i)), "hits")
        taken = own if taken is None else taken.unionByName(own)
        left -= own.count()
    return taken.orderBy("type_ordinal", "line_number", "provider", "full_path", "match_line").limit(max(1, limit)).select("full_path", "line_number", "match_line", "match_type", "type_ordinal")


def _above(sums: DataFrame) -> DataFrame:
    """(__cell, __above): the total of column __sum over all greater cells.

    More than CELLS cells, as sparse ids give, are summed in ranges of CELLS first, and so on up.
    """
    greater = lambda w: F.coalesce(F.sum("__sum").over(w.orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums, "sums")
    if sums.limit(CELLS + 1).count() <= CELLS:
        return sums.select("__cell", greater(Window.partitionBy()).alias("__above"))
    upper = F.floor(F.col("__cell") / CELLS)
    over = _above(sums.groupBy(upper.alias("__cell")).agg(F.sum("__sum").alias("__sum"))).withColumnsRenamed({"__cell": "__upper", "__above": "__start"})
    own = sums.withColumn("__upper", upper).withColumn("__own", greater(Window.partitionBy("__upper")))
    return own.join(over, "__upper").select("__cell", (F.col("__own") + F.col("__start")).alias("__above"))


def running_trim(df: DataFrame, order: str, size: str, most: int, chunk: int) -> DataFrame:
    """Rows, from the newest ``order`` down, whose running total of ``size`` stays within ``most``.

    ``order`` is an integer; rows are summed in ranges of ``chunk`` first, and those in ranges of ranges, so no task
    sorts more than a range.
    """
    cell = F.floor(F.col(order) / chunk)
    start = _above(df.groupBy(cell.alias("__cell")).agg(F.sum(size).alias("__sum")))
    inside = Window.partitionBy("__cell").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__cell", cell).join(start, "__cell")
    return rows.withColumn("__run", F.col("__above") + F.sum(size).over(inside)).where(F.col("__run") <= most).drop("__cell", "__above", "__run")
