"""Secret scans leave ordinary URLs, paths, names and versions alone, and still find keys in them."""

import random
import string

from pyspark.sql import functions as F

from lodeframe.llm import secrets

WORDS = "introduction programming article index user config service manager abstract factory bean template catalyst optimizer internal release snapshot windows archive category product review history science travel garden kitchen music".split()


def ordinary(draw):
    for _ in range(150):
        a = [draw.choice(WORDS) for _ in range(5)]
        n = [draw.randrange(20) for _ in range(3)]
        yield f"https://www.example.org/{a[0]}/{a[1]}/{'-'.join(a[2:])}.html"
        yield f"org.{a[0]}.{a[1]}.{a[2].title()}Factory{a[3].title()}Impl"
        yield f"/usr/lib/{a[0]}/{a[1]}-{n[0]}.{n[1]}.{n[2]}/{a[2]}.jar"
        yield f"{n[0]}.{n[1]}.{n[2]}-20240{draw.randrange(1, 9)}15.{draw.randrange(10**5, 10**6)}-SNAPSHOT"
        yield "_".join(a[:4])
        yield "".join(x.title() for x in a[:4])


def keys(draw):
    for letters in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits):
        for _ in range(100):
            yield "".join(draw.choice(letters) for _ in range(24))


def test_ordinary_strings_stay_and_keys_are_found(spark):
    draw = random.Random(12)
    pages = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(s, "plain") for s in ordinary(draw)] + [(s, "key") for s in keys(draw)] + [(u, "page") for u in pages]
    df = spark.createDataFrame(rows, "s string, kind string").withColumn("text", F.concat(F.lit("see "), F.col("s"), F.lit(" here"))).repartition(8)
    found = secrets.find_secrets(df, model).withColumn("hit", F.exists("spans", lambda x: x["kind"] == 3))
    counts = {r["kind"]: (r["n"], r["hits"]) for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).collect()}
    plain, key, page = counts["plain"], counts["key"], counts["page"]
    assert page == (len(pages), 0)
    assert key[1] >= 0.9 * key[0] and plain[0] == 900 and plain[1] <= 0.01 * plain[0], counts
    # Keys found of all strings that are reported, among as many ordinary ones and more.
    assert key[1] >= 0.98 * (key[1] + plain[1] + page[1])


def test_a_key_inside_a_path_is_found_alone(spark):
    key = "x7Qp2LmZ9vT4kRw8YbN3cHs6"
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = [f"é https://www.example.org/articles/introduction/{key}/programming/index.html", f"/{key}", f"some/usual/path/{key}/{key[::-1]}/more/of/the/same/kind/of/path"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["r"] for r in secrets.find_secrets(df, model).withColumn("r", secrets.redact(F.col("text"), F.col("spans"))).collect()]
    assert got[0] == "é https://www.example.org/articles/introduction/[SECRET]/programming/index.html"
    assert key not in got[1] and got[2] == "some/usual/path/[SECRET]/[SECRET]/more/of/the/same/kind/of/path"
