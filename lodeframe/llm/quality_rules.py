"""Quality rules per document and per host.

Word, symbol and repetition rules are counted inside each row with DataFrame functions. Failures are aggregated by
host (many rows of one host merge before they shuffle), each host's failure rate is shrunk towards the mean of all hosts
with a beta prior fitted by the method of moments, and the hosts' verdicts are joined back to their documents.

Null and empty texts have no words and fail. A null host has no verdict: its documents are judged by the base
rules alone. Repeated rows count as often as they appear; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key

SPACE = " \t\n\v\f\r"
#: Fixed values of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "[#*$%&|<>]"
#: Bits kept for the position in a sorted window; longer texts sort whole hashes.
POSITION_BITS = 20
#: A host is rejected above this shrunken rate; symbols per 100 words and repeated lines per 100 lines that count as failures.
MAX_HOST_RATE, MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = 0.5, 10, 30


def rule_counts(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.btrim(text, F.lit(SPACE))
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(host_col).cast("string").alias("host"),
        F.when(body == "", none).otherwise(F.split(body, r"[\x20\x09-\x0D]+", -1)).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    # A window of three words is known by a 64-bit hash of its words; the last two positions begin none.
    windows = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.size("words") - 2, F.lit(0)))
    rows = rows.select(
        "id", "host", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts that repeat a window sort theirs: first a long of hash bits above and position below, which leaves few
    # candidates, then the whole hashes of those. Each step is a projection of its own, so none is computed twice.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    low = (1 << POSITION_BITS) - 1
    packed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i)))
    rows = rows.select("*", F.when(repeats & (F.size("windows") <= low), packed).alias("packed"), (repeats & (F.size("windows") > low)).alias("long"))

    def alike(x: Column, i: Column) -> Column:
        beside = F.get("packed", F.when(i >= 0, i))
        return F.coalesce(F.shiftright(x.bitwiseXOR(beside), POSITION_BITS) == 0, F.lit(False))

    near = F.transform(F.filter("packed", lambda x, i: alike(x, i - 1) | alike(x, i + 1)), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    rows = rows.select("*", F.when(F.col("long"), F.sequence(F.lit(0), F.size("windows") - 1)).otherwise(near).alias("near"))
    rows = rows.select("*", F.sort_array(F.transform("near", lambda i: F.struct(F.get("windows", i).alias("h"), i.alias("i")))).alias("placed"))
    same = F.filter("placed", lambda x, i: ((i > 0) & (x["h"] == F.get("placed", i - 1)["h"])) | F.coalesce(x["h"] == F.get("placed", i + 1)["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    return rows.select("id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(starts), F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def _covered(starts: Column) -> Column:
    """Positions covered by windows of three at sorted ``starts``."""
    zero = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments from the failure rates of hosts (n, failed); (0, 0) where rates do not vary."""
    rate = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    if not var or var >= mean * (1 - mean):
        return 0.0, 0.0
    weight = mean * (1 - mean) / var - 1
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate) of every row."""
    counts = rule_counts(docs, id_col, host_col, text_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = base | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("n_lines"))
    counts = materialize(counts.withColumns({"base_failed": base, "failed": failed}).drop("n_lines"), "rules")
    hosts = materialize(counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rates = hosts.select("host", ((F.col("failed") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"), "n")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    judged = join_per_key(counts.drop("failed"), rates, "host", "n", total, how="left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
