"""Intermediate tables in the folder that driver and executors share.

Long or iterative plans are cut by writing a table below ``spark.checkpoint.dir`` and reading it
back: a lost executor then costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Paths written by each application, in order.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has written and not released."""
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it, with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> int:
    """Delete the given tables, or all; call it once no DataFrame built on them is needed. Returns the number."""
    mine = written(spark)
    gone = list(mine if paths is None else paths)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
        mine.remove(name)
    return len(gone)
