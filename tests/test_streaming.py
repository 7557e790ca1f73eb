"""Streams of changes against the same rows as a batch."""

from pyspark.sql import functions as F

from lodeframe.streaming import changes


def drained(stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).alias("path"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 40 * 60).alias("at"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    first = drained(changes.first_reports(stream(), ["path"], "at", "2 hours"), "append", tmp_path, "first_reports")
    assert sorted(r["path"] for r in first.collect()) == list(range(20))
    counts = drained(changes.windowed_counts(stream(), ["path"], "at", "10 minutes", "1 hour"), "complete", tmp_path, "windowed_counts")
    want = rows.groupBy(F.window("at", "10 minutes")["start"].alias("window_start"), "path").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
