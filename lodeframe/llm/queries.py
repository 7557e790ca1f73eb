"""The registered queries of the numbered operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeframe.llm.alignment import alignment_statistics
from lodeframe.llm.bpe import bpe_decode, bpe_encode
from lodeframe.llm.exact_dedup import exact_duplicates
from lodeframe.llm.language_id import fold, predict_language, train_language_id
from lodeframe.llm.line_dedup import dedup_lines
from lodeframe.llm.packing import pack
from lodeframe.llm.prefix_bpe import byte_bpe_decode, byte_bpe_encode
from lodeframe.llm.quality_model import score_quality, train_quality
from lodeframe.llm.quality_rules import judge
from lodeframe.llm.secrets import count_kind, find_secrets, spans_text, train
from lodeframe.llm.simhash import near_duplicates, unsigned_hex
from lodeframe.llm.token_counts import count_tokens
from lodeframe.llm.whitening import embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file; the package that holds the files is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The split pattern of the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    decoded = bpe_decode(bpe_encode(documents(spark, sf), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf: str, model: str | None = None) -> DataFrame:
    return count_tokens(documents(spark, sf), model or tokenizer_path("piece_bpe_32k.model"), limit=4096)


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf), bits=2, width=3)
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), F.col("component").alias("component_id"))


LINE_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS dropped FROM k LEFT JOIN f ON k.key = f.key)
"""


@query(
    "op9_line_dedup",
    LINE_DEDUP_SQL
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
       FROM m GROUP BY doc_id""",
)
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf).select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


@query(
    "op10_exact_dedup",
    """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
       g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
       SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
)
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    found = find_secrets(docs, train(docs))
    return found.select(
        "doc_id",
        *(count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        sha256(spans_text(F.col("base_spans"))).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@query(
    "op8_quality_rules",
    r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
c AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS bad FROM f GROUP BY source),
m AS (SELECT avg(bad / n) AS mu, var_samp(bad / n) AS v FROM h),
k AS (SELECT mu, CASE WHEN v > 0 AND v < mu * (1 - mu) THEN mu * (1 - mu) / v - 1 ELSE 0 END AS weight FROM m),
j AS (SELECT source, (bad + mu * weight) / (n + weight) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM f LEFT JOIN j USING (source)
""",
)
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(documents(spark, sf)).drop("host_rate")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), split_pattern(), capacity=2048, end_id=1)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = train_language_id(docs.where(~held_out))
    return predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    net = train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out))
    scored = score_quality(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf: str, ranks: str | None = None) -> DataFrame:
    path = ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe_decode(byte_bpe_encode(documents(spark, sf), path, split_pattern()), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = embedding_whitening(spark.read.parquet(f"{sf}/embeddings.parquet"), components=4, scale=256.0)
    # Null beyond 64 bits; the operator's own column has 38 digits.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment_statistics(documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), split_pattern(), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
