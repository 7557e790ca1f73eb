"""Columns over arrays and maps."""

from pyspark.sql import functions as F

from lodeframe.functions import collections as c


def test_maps(spark):
    df = spark.createDataFrame([({"a": [1], "b": []}, {"a": [2], "d": None}), ({}, {})], "x map<string,array<int>>, y map<string,array<int>>")
    rows = df.select(c.merge_maps(F.col("x"), F.col("y")).alias("m"), c.drop_empty(c.merge_maps(F.col("x"), F.col("y"))).alias("d")).collect()
    assert [(r.m, r.d) for r in rows] == [({"a": [2], "b": [], "d": None}, {"a": [2]}), ({}, {})]


def test_arrays(spark):
    df = spark.createDataFrame([([1, 1, 2], [1, 2, 2]), ([1], [2]), ([], [])], "x array<int>, y array<int>")
    big = lambda v: v > 1
    rows = df.select(c.same_elements(F.col("x"), F.col("y")), c.single(F.col("x"), big), c.single(F.col("y"), big), c.none_match(F.col("x"), big)).collect()
    assert list(map(tuple, rows)) == [(True, 2, None, False), (False, None, 2, True), (True, None, None, True)]
