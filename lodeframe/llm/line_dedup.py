"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded with their positions, normalised and hashed (128 bits), the distinct documents per hash are counted,
and the hashes over the threshold are joined back to the positions that hold them; each text is reassembled from the
lines at its other positions. Line rows carry hashes only, never text. Counting distinct documents merges
per task before it shuffles, and the join back is salted against hot lines by broadcasting the few of them. Work
per text is linear in its lines.

A null or empty text is one empty line. Rows that repeat a doc_id count as one document and, when it is the
largest that holds a line, all keep it; each row loses its own positions. Null ids are one document, smaller than all
others. Lines within one document are not compared. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\v\f\r"


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, and nothing else: ``lower`` does just that, and fast, where all characters are single bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return lower_az(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` deduplicated and the columns n_lines and n_dropped (long) added.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines
    except in the largest id holding one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    # A row is known by its id and its text: rows that repeat an id may differ in text.
    row = F.xxhash64(text)
    # The text must not be needed above the explode, or each line would carry a copy of it. An inner explode would have Spark
    # split each text a second time, to tell whether it has lines; all have.
    own = docs.select(F.col(id_col).alias("id"), row.alias("row"), lines.alias("ls"))
    every = own.select("id", "row", F.posexplode_outer("ls").alias("pos", "line")).where(F.length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    key = line_key(F.col("line"))
    held = materialize(every.select("id", "row", "pos", F.xxhash64(key).alias("x"), F.xxhash64(F.lit(1), key).alias("y")), "lines")
    found = held.groupBy("x", "y").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("last"), F.count("*").alias("rows"))
    frequent = materialize(found.where(F.col("n") >= min_docs).select(F.struct("x", "y").alias("k"), "last", "rows"), "frequent")
    total = frequent.agg(F.sum("rows")).first()[0] or 0
    hits = join_per_key(held.select("id", "row", "pos", F.struct("x", "y").alias("k")), frequent, "k", "rows", total)
    # At most the positions of one text; rows repeated whole give each position as often as they appear.
    drops = hits.where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("__drops"))
    # Names of the added columns win over input columns of the same name.
    rows = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), row.alias("__row"))
    same = rows[id_col].eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__own"))
    joined = rows.join(drops.withColumnsRenamed({"id": "__id", "row": "__own"}), same, "left")
    joined = joined.withColumn("__lines", lines)
    # One flag per line, from the gaps between drops: a look-up of each line among the drops would be quadratic.
    cuts = F.concat(F.array(F.lit(-1)), "__drops")
    joined = joined.withColumn("__gaps", F.when(F.col("__drops").isNotNull(), F.zip_with(cuts, F.concat("__drops", F.array(F.size("__lines"))), lambda a, b: b - a - 1)))
    flags = F.slice(F.flatten(F.transform("__gaps", lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True))))), F.lit(1), F.size("__lines"))
    # Flags are an operand, not part of a lambda, where they could be computed anew for each line.
    flagged = F.filter(F.zip_with("__lines", flags, lambda x, drop: F.struct(x.alias("x"), drop.alias("drop"))), lambda l: ~l["drop"])
    kept = F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(F.transform(flagged, lambda l: l["x"]), "\n"))
    return joined.select(
        *(kept.alias(c) if c == text_col else c for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
