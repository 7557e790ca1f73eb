"""Line tables: one row per line of a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def java_lines(text: Column) -> Column:
    """Lines of a text: CRLF and CR count as LF, trailing empty lines are dropped, an empty text has one line."""
    lf = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    cut = F.regexp_replace(lf, "\n+\\z", "")
    return F.when(text == "", F.array(F.lit(""))).when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\n"))


def lines(df: DataFrame, path: str, text: str) -> DataFrame:
    """(full_path, line_no from 1, line) of each text; null texts have no lines."""
    return df.select(F.col(path).cast("string").alias("full_path"), F.posexplode(java_lines(F.col(text))).alias("p", "line")).select(
        "full_path", (F.col("p") + 1).alias("line_no"), "line"
    )
