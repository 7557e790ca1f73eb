"""Training samples neither vanish nor grow, whatever the number of rows and however ids repeat."""

import pytest
from pyspark.sql import DataFrame, functions as F

from lodeframe.llm import language_id, quality_model, secrets
from lodeframe.llm.sampling import sample_rows, smallest_keys


def texts(spark, ids, lang="'en'"):
    words = F.concat(F.lit("plain text of number "), F.col("id"), F.lit(" with_identifiers.of.row_"), F.col("id"))
    return spark.range(3000).select(F.expr(ids).cast("long").alias("doc_id"), words.alias("text"), F.expr(lang).alias("lang")).cache()


CASES = {"ids": "id", "null ids": "NULL", "one id": "7"}


@pytest.mark.parametrize("ids", CASES.values(), ids=CASES)
@pytest.mark.parametrize("count", [3000, 10**10, 10**13])
def test_samples_have_their_size(spark, ids, count):
    rows = texts(spark, ids)
    found = smallest_keys(rows, ["doc_id", "text"], {"": count}, 20)[""]
    drawn = sample_rows(rows, ["doc_id", "text"], {"": count}, 20)
    assert len(found) == drawn.distinct().count() == 20
    every = smallest_keys(rows, ["doc_id", "text"], {"": count}, 5000)[""]
    assert len(every) == 3000 and every[:20] == found
    # Repeated rows are one, and don't change what is drawn.
    again = sample_rows(rows.union(rows).union(rows), ["doc_id", "text"], {"": 3 * count}, 20)
    assert again.count() == 20 and again.exceptAll(drawn).count() == 0


def test_labels_are_drawn_apart(spark):
    rows = texts(spark, "id", "CASE WHEN id < 2900 THEN 'en' WHEN id < 2990 THEN 'de' ELSE 'fr' END")
    counts = {"en": 2900, "de": 90, "fr": 10}
    drawn = {r["lang"]: r["count"] for r in sample_rows(rows, ["lang", "doc_id", "text"], counts, 50, "lang").groupBy("lang").count().collect()}
    assert drawn == {"en": 50, "de": 50, "fr": 10}
    assert sample_rows(rows, ["text"], {}, 5).count() == 0 and sample_rows(rows.limit(0), ["text"], {"": 0}, 5).count() == 0


@pytest.mark.parametrize("ids", CASES.values(), ids=CASES)
def test_language_sample(spark, ids):
    rows = texts(spark, ids, "CASE WHEN crc32(cast(id AS string)) % 2 = 0 THEN 'en' ELSE 'de' END")
    for n in (1500, 16 * 10**8):
        found = language_id._sample(rows, {"en": n, "de": n}, "doc_id", "text", "lang", 20)
        assert sorted(x[0] for x in found) == ["de"] * 20 + ["en"] * 20


def test_language_model_does_not_vanish(spark, monkeypatch):
    """With the counts of a very large corpus two languages are still told apart."""
    words = {"en": "the house and the garden of this people with words ", "de": "das haus und der garten dieser leute mit wörtern "}
    rows = spark.createDataFrame([(None, f"{words[k]} {i}", k) for i in range(300) for k in words], "doc_id long, text string, lang string")
    kept = language_id._sample
    monkeypatch.setattr(language_id, "_sample", lambda labelled, langs, *a: kept(labelled, {k: n * 10**8 for k, n in langs.items()}, *a))
    found = language_id.predict_language(rows, language_id.train_language_id(rows))
    assert found.where("lang_pred <> lang").count() == 0 and found.where("score < 0.5").count() == 0


@pytest.mark.parametrize("ids", CASES.values(), ids=CASES)
def test_secret_samples(spark, ids, monkeypatch):
    rows = texts(spark, ids)
    monkeypatch.setattr(DataFrame, "count", lambda self: 10**10)
    ordinary = secrets.labelled_samples(rows, 10, 20).where("not is_random").collect()
    assert len({r["sample"] for r in ordinary if "row_" in r["sample"]}) == 20


def test_quality_sample_is_bounded_in_documents_and_passages(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality_model, "fit", lambda bags, labels: taken.append((len(bags), sum(map(len, bags)))))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit(" word"), 500)).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    same = docs.select(F.lit(7).cast("long").alias("doc_id"), "text")
    for d, lab in ((docs, labels), (same, labels.where("doc_id = 7")), (docs, labels.union(labels).union(labels))):
        quality_model.train_quality(d, lab, sample=40, passages=60)
        quality_model.train_quality(d, lab, sample=40, passages=10_000)
    # A text is three passages.
    assert [x for x, _ in taken] == [20, 40] * 3 and [n for _, n in taken] == [60, 120] * 3
    assert quality_model.train_quality(docs, labels.limit(0)) is None and quality_model.train_quality(docs, labels.withColumn("doc_id", F.lit(None).cast("long"))) is None
