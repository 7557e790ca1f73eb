"""Line dedup: one split a text, and A-Z alone lower-cased."""

from pyspark.sql import functions as F

from lodeframe.llm import line_dedup


def test_lines_are_split_once_and_only_a_to_z_is_lowered(spark, monkeypatch):
    odd = ["AZ", "ÄÖ Aß", "K\u0130S", "\u212aA", "\ud7ffZ\U0001f600Q", ""]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    assert [r[0] for r in df.select(line_dedup.lower_az(F.col("t"))).collect()] == ["".join(c.lower() if c < "\x80" else c for c in x) for x in odd]
    plans, plain = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).count()
    assert plans[0].count("split(") == 1
