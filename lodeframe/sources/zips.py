"""Export to zip files through Spark's writer protocol: one zip a task, moved into place when the job commits.

A task writes its zip and its failures below ``_temporary`` under a name of its own attempt; only attempts that the job commits are
moved to ``part-00000.zip`` and so on, so a retried or speculative task leaves no double entries, and an aborted job no parts
(tasks that still ran when it was aborted may leave their ``_temporary`` folder). Entries of different parts have different names if targets do: take ``sinks.export_plan`` first.
The folder must be a local path or a URI that ``pyarrow`` opens, shared by the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "lodeframe_zip"
#: A fixed time for all entries, so that a retried task writes the same bytes.
TIME = (1980, 1, 1, 0, 0, 0)
FAILURES = "item string, reason string"


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its number, the name of its attempt, and how many entries and failures."""

    number: int
    attempt: str
    written: int
    failed: int


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str, mode: str):
        self.folder, self.mode, self.job = folder, mode, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        return system, path.rstrip("/"), f"{path.rstrip('/')}/_temporary-{self.job}"

    def write(self, rows: Iterator[Row]) -> Part:
        context = TaskContext.get()
        system, _, temporary = self._open()
        system.create_dir(temporary, recursive=True)
        attempt, written, failures = f"{context.partitionId()}-{uuid.uuid4().hex}", 0, []
        with system.open_output_stream(f"{temporary}/{attempt}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                if row["target"] is None or row["content"] is None:
                    failures.append({"item": row["item"], "reason": "no content" if row["content"] is None else "no target"})
                    continue
                z.writestr(zipfile.ZipInfo(row["target"], TIME), bytes(row["content"]), zipfile.ZIP_DEFLATED)
                written += 1
        with system.open_output_stream(f"{temporary}/{attempt}.json") as out:
            out.write("".join(json.dumps(f) + "\n" for f in failures).encode())
        return Part(context.partitionId(), attempt, written, len(failures))

    def commit(self, messages: list[Part | None]) -> None:
        system, folder, temporary = self._open()
        if self.mode == "overwrite" and system.get_file_info(folder).type != fs.FileType.NotFound:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.base_name.startswith(("part-", "failures-")):
                    system.delete_file(old.path)
        for part in filter(None, messages):
            system.move(f"{temporary}/{part.attempt}.zip", f"{folder}/part-{part.number:05d}.zip")
            system.move(f"{temporary}/{part.attempt}.json", f"{folder}/failures-{part.number:05d}.json")
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)

    def abort(self, messages: list[Part | None]) -> None:
        system, _, temporary = self._open()
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)


class ZipExport(DataSource):
    """``df.write.format(FORMAT)`` for rows (item, target, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        if [f.name for f in schema.fields] != ["item", "target", "content"]:
            raise ValueError("columns item, target and content are needed")
        return ZipWriter(self.options["path"], "overwrite" if overwrite else "append")


def export_zips(plan: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Writes the rows of an ``export_plan`` whose action is write as zip parts below ``folder``, earlier parts being replaced, and
    returns (item, reason) of those that could not be written, rejected ones with them."""
    spark: SparkSession = plan.sparkSession
    spark.dataSource.register(ZipExport)
    body = F.col(content).cast("binary")
    rows = plan.where("action = 'write'").select(F.col(path).cast("string").alias("item"), F.col("target").cast("string").alias("target"), body.alias("content"))
    rows.write.format(FORMAT).mode("overwrite").save(folder)
    failed = spark.read.schema(FAILURES).json(f"{folder.rstrip('/')}/failures-*.json")
    return failed.unionByName(plan.where("action = 'reject'").select(F.col(path).cast("string").alias("item"), F.lit("no safe path").alias("reason")))
