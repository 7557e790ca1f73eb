"""Entries of files, directories and (nested) archives as rows.

Files are listed and read by Spark's ``binaryFile`` source; each archive is opened by the task that reads it. An
archive is one row of that source, so a task holds one archive and its current entry, never a whole directory.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Suffixes of resources and of archives, and the deepest nesting that is read.
RESOURCE_SUFFIXES = (
    "xml", "json", "properties", "txt", "html", "css", "js", "md", "yml", "yaml", "cfg", "ini", "sh", "bat", "sql",
    "png", "jpg", "jpeg", "gif", "bmp", "svg", "ico", "webp",
)
ARCHIVE_SUFFIXES = (".jar", ".zip")
MAX_DEPTH = 8
#: Bytes of entries in one batch handed to Spark.
BATCH_BYTES = 16 << 20
ENTRY = "path string, name string, depth int, content binary, length long, mtime timestamp, classpath_idx int, entry_idx int"


def node_type(name: Column) -> Column:
    """CLASS_FILE, JAVA_FILE, RESOURCE or BINARY by the suffix, in either case."""
    low = F.lower(name)
    resource = low.rlike(r"\.(" + "|".join(RESOURCE_SUFFIXES) + r")$")
    return F.when(low.endswith(".class"), "CLASS_FILE").when(low.endswith(".java"), "JAVA_FILE").when(resource, "RESOURCE").otherwise("BINARY")


def _walk(path: str, content: bytes, max_depth: int, failed: list) -> Iterator[tuple[str, int, bytes]]:
    """(path, depth, bytes) of all entries; what cannot be read, an archive or an entry, goes to ``failed`` as (path, error)."""
    stack = [(path, content, 1, "")]
    while stack:
        at, data, depth, prefix = stack.pop()
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    name = prefix + info.filename
                    try:
                        body = z.read(info)
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError) as e:
                        failed.append((name, str(e) or type(e).__name__))
                        continue
                    yield name, depth, body
                    if info.filename.lower().endswith(ARCHIVE_SUFFIXES) and depth <= max_depth:
                        stack.append((name, body, depth + 1, name + ":"))
        except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError) as e:
            failed.append((at, str(e) or type(e).__name__))


def expand_archives(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries (``ENTRY``) of files (path, content, length, mtime, classpath_idx).

    Entries of a JAR or ZIP carry the path inside it, those of an archive in it ``inner.jar:path``; archives nested
    deeper than ``max_depth`` are listed, not opened. Other files are one entry each, as are empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                path, content, mtime, idx = (batch.column(c)[i].as_py() for c in ("path", "content", "mtime", "classpath_idx"))
                whole = content or b""
                entries = _walk(path, whole, max_depth, []) if path.lower().endswith(ARCHIVE_SUFFIXES) else [(path, 0, whole)]
                for n, (name, depth, body) in enumerate(entries):
                    held.append((name, name.rsplit("/", 1)[-1].rsplit(":", 1)[-1], depth, body, len(body), mtime, idx, n))
                    size += len(body)
                    if size >= BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)

    return files.select("path", "content", F.col("modificationTime").alias("mtime") if "modificationTime" in files.columns else "mtime", "classpath_idx").mapInArrow(run, ENTRY)


def unreadable(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(archive, path, error) of the archives of ``files``, those inside them and entries that ``expand_archives`` cannot read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = []
            for path, content in zip(batch.column(0), batch.column(1)):
                found = []
                for _ in _walk(path.as_py(), content.as_py() or b"", max_depth, found):
                    pass
                failed += [(path.as_py(), at, error) for at, error in found]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in failed], pa.string()) for i in range(3)], names=["archive", "path", "error"])

    archives = files.where(F.lower("path").rlike("(" + "|".join(ARCHIVE_SUFFIXES).replace(".", r"\.") + ")$"))
    return archives.select("path", "content").mapInArrow(run, "archive string, path string, error string")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("content", pa.binary()), ("length", pa.int64()),
             ("mtime", pa.timestamp("us", tz="UTC")), ("classpath_idx", pa.int32()), ("entry_idx", pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))


def _archive(spark: SparkSession, element: str) -> str | None:
    """The full path of an element that is one archive; null for directories, patterns and other files."""
    if element.lower().endswith(ARCHIVE_SUFFIXES):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(element)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path) and system.getFileStatus(path).isFile():
            return system.getFileStatus(path).getPath().toString()
    return None


def read_entries(spark: SparkSession, elements: Sequence[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries of the class path ``elements`` in their order, with node_type; directories are read recursively.

    The paths of a directory's files are relative to it.
    """
    load = spark.read.format("binaryFile").option("recursiveFileLookup", True).load
    bare = lambda path: re.sub(r"^[A-Za-z0-9]+:/*|^/+", "", path.rstrip("/"))
    inside = F.regexp_replace("path", r"^[A-Za-z0-9]+:/*", "")
    parts, single = [], []
    for i, element in enumerate(elements):
        qualified = _archive(spark, element)
        if qualified:
            single.append((qualified, i))
            continue
        base = bare(element) + "/"
        short = F.when(inside.startswith(base), F.substring(inside, F.lit(len(base) + 1), F.length(inside))).otherwise(F.substring_index("path", "/", -1))
        parts.append(load(element).withColumns({"path": short, "classpath_idx": F.lit(i)}))
    if single:
        # One scan, however many archives the class path names.
        order = spark.createDataFrame(single, "__at string, classpath_idx int")
        files = load(sorted({at for at, _ in single})).withColumn("__at", F.col("path"))
        parts.append(files.join(F.broadcast(order), "__at").drop("__at").withColumn("path", F.substring_index("path", "/", -1)))
    return expand_archives(reduce(DataFrame.unionByName, parts), max_depth).withColumn("node_type", node_type(F.col("name")))


def mask_duplicates(entries: DataFrame) -> DataFrame:
    """The first entry of each path in class path order; module-info and package-info classes all stay.

    The content is left out of the aggregate: positions are compared, and the rows that win are kept by a semi join.
    """
    free = F.col("name").isin("module-info.class", "package-info.class")
    first = entries.where(~free).groupBy("path").agg(F.min(F.struct("classpath_idx", "entry_idx")).alias("p")).select("path", "p.*")
    return entries.where(free).unionByName(entries.join(first, ["path", "classpath_idx", "entry_idx"], "left_semi").select(*entries.columns))


def elements_with(entries: DataFrame, paths: Sequence[str], element: str = "classpath_idx", path: str = "path") -> DataFrame:
    """``entries`` of the class path elements that contain one of ``paths``."""
    return entries.join(entries.where(F.col(path).isin(*paths)).select(element).distinct(), element, "left_semi").select(*entries.columns)


def elements_without(entries: DataFrame, paths: Sequence[str], element: str = "classpath_idx", path: str = "path") -> DataFrame:
    """``entries`` of the class path elements that contain none of ``paths``."""
    return entries.join(entries.where(F.col(path).isin(*paths)).select(element).distinct(), element, "left_anti").select(*entries.columns)


def latest_change(files: DataFrame, now: Column | None = None, mtime: str = "mtime") -> DataFrame:
    """One row (last_modified): the latest change before ``now`` in ms, later ones being ignored; 0 without any."""
    ms = F.unix_millis(mtime)
    return files.agg(F.coalesce(F.max(F.when(ms < F.unix_millis(F.current_timestamp() if now is None else now), ms)), F.lit(0)).alias("last_modified"))


def indexed_resources(entries: DataFrame, most: int = 5 << 20) -> DataFrame:
    """Resources that a text index takes: not empty and at most ``most`` bytes."""
    return entries.where((F.col("node_type") == "RESOURCE") & F.col("length").between(1, most))


def content_stamp(files: DataFrame, mtime: str = "mtime", length: str = "length") -> DataFrame:
    """One row (stamp): latest change in ms, bytes and number of files, joined by underscores; 0_0_0 without files."""
    ms = F.coalesce(F.max(F.unix_millis(mtime)), F.lit(0))
    return files.agg(F.concat_ws("_", ms, F.coalesce(F.sum(length), F.lit(0)), F.count("*")).alias("stamp"))


def manifest_changes(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or modified between two listings; keys that are equal in ``compared`` are left out."""
    a = old.select(key, F.struct(*compared).alias("__old"))
    b = new.select(key, F.struct(*compared).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")
