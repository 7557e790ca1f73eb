"""Zip parts: every entry once, failures as rows, nothing left of failed tasks."""

import glob
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.sources import archives, sinks, zips


def entries(folder):
    found = {}
    for part in sorted(glob.glob(f"{folder}/part-*.zip")):
        with zipfile.ZipFile(part) as z:
            for name in z.namelist():
                assert name not in found
                found[name] = z.read(name)
    return found


def test_zip_parts(spark, tmp_path):
    rows = [(i, f"p{i % 7}/f{i}.txt", bytearray(f"text {i}".encode())) for i in range(200)] + [(500, "p0/f0.txt", bytearray(b"later")), (501, "../up", bytearray(b"x")), (502, "none", None), (503, "a/é.txt", bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, path string, content binary").repartition(6)
    for policy, first in (("SKIP", b"text 0"), ("OVERWRITE", b"later")):
        folder = str(tmp_path / policy)
        failed = zips.export_zips(sinks.export_plan(df, "path", "id", policy), folder)
        assert sorted(map(tuple, failed.collect())) == [("../up", "no safe path"), ("none", "no content")]
        found = entries(folder)
        assert len(found) == 201 and found["p0/f0.txt"] == first and found["a/é.txt"] == b""
    renamed = str(tmp_path / "rename")
    zips.export_zips(sinks.export_plan(df, "path", "id", "RENAME"), renamed)
    assert entries(renamed)["p0/f0_2.txt"] == b"later" and len(entries(renamed)) == 202
    # Fewer parts replace more.
    zips.export_zips(sinks.export_plan(df.where("id < 3"), "path", "id", "SKIP").coalesce(1), renamed)
    assert len(entries(renamed)) == 3 and not glob.glob(f"{renamed}/_temporary*")
    assert archives.read_entries(spark, [str(tmp_path / "SKIP")]).where("name = 'f7.txt'").count() == 1


def test_attempts_that_fail_leave_nothing(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("item"), F.col("id").cast("string").alias("target"), F.lit(b"x").alias("content"))
    spark.dataSource.register(zips.ZipExport)
    broken = df.withColumn("content", F.when(F.col("item") == "33", F.raise_error("broken").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format(zips.FORMAT).mode("overwrite").save(str(tmp_path / "out"))
    # Tasks that still ran may leave their own folder.
    assert not glob.glob(f"{tmp_path}/out/part-*") and not glob.glob(f"{tmp_path}/out/failures-*")
    # Only the attempts that are committed count.
    writer = zips.ZipWriter(str(tmp_path / "again"), "append")
    os.makedirs(writer._open()[2])
    for name in ("0-first", "0-second"):
        for end in ("zip", "json"):
            open(f"{writer._open()[2]}/{name}.{end}", "w").write(name)
    writer.commit([zips.Part(0, "0-second", 1, 0), None])
    assert sorted(os.listdir(tmp_path / "again")) == ["failures-00000.json", "part-00000.zip"] and open(tmp_path / "again" / "part-00000.zip").read() == "0-second"
