"""Exact dedup by skew-safe combining.

Texts are deduplicated inside each task (partial aggregation by digest and content), the survivors of all tasks
merge per (digest, content, salt), and the salt winners merge once more over all salts. Content is a grouping key
at every stage, so a digest collision can't merge different texts; what each stage passes on is one row per
distinct text and salt, whatever the number of copies.

Members find their group by digest. Where a digest stands for two contents, which a check of the winners shows,
those members are compared by content instead.

Null texts count as empty and equal each other. Of rows that repeat a doc_id all stay if it is the largest of its
group. Null ids are below all others. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size long, kept, text_sha256) of every row; keep_id is the largest id of equal texts."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    salted = rows.groupBy("digest", "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(F.max("id").alias("best"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "content").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    # Winners keep no content: a digest with one content needs none, and the others are compared below.
    groups = winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("contents"))
    groups = materialize(groups, "groups")
    total, most = groups.agg(F.sum("group_size"), F.max("contents")).first()
    out = join_per_key(rows.select("id", "digest"), groups.where("contents = 1").drop("contents").withColumn("w", F.col("group_size")), "digest", "w", total or 0)
    if (most or 0) > 1:
        clash = groups.where("contents > 1").select("digest")
        exact = winners.join(clash, "digest", "left_semi")
        out = out.unionByName(rows.join(clash, "digest", "left_semi").join(exact, ["digest", "content"]).drop("content"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
