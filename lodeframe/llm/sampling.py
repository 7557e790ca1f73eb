"""Bounded samples that depend on what rows hold and on nothing else: those with the smallest hashes.

A sample is the ``n`` distinct keys of a label with the smallest 64-bit hashes, whatever the number of rows. Rows are first thinned by
a threshold over all 63 bits that the number of rows suggests; where it lets too few through, it is widened until there are
enough, or all rows pass. So no number of rows rounds a share to nothing, and rows with null or repeated ids, which differ in
their text, are drawn like others. Rows that repeat a whole key are one.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Hashes have so many bits; keys asked for beyond twice ``n``, and how much wider a threshold gets.
BITS, MORE, WIDER = 63, 100, 16


def key_hash(*columns: str | Column) -> Column:
    """63-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def _limit(label: Column | None, limits: Mapping[Hashable, int]) -> Column:
    """The limit of a row's label, null for labels that aren't asked for."""
    if label is None:
        return F.lit(next(iter(limits.values())))
    return F.coalesce(*(F.when(label == F.lit(k), F.lit(v)) for k, v in limits.items()))


def smallest_keys(rows: DataFrame, keys: Sequence[str | Column], counts: Mapping[Hashable, int], n: int, label: str | None = None, size: Column | None = None) -> dict[Hashable, list[tuple[int, int]]]:
    """label -> ascending (hash, size) of its ``n`` smallest distinct keys, or of all if there are fewer.

    ``counts`` are the rows of each label, or of all under any one name where there is no ``label``.
    """
    own = F.lit("").alias("__label") if label is None else F.col(label).alias("__label")
    narrow = rows.select(own, key_hash(*keys).alias("__h"), (F.lit(1) if size is None else size).cast("long").alias("__size"))
    share = {k: min(1.0, (2 * n + MORE) / max(1, c)) for k, c in counts.items()}
    out: dict[Hashable, list[tuple[int, int]]] = {}
    while len(out) < len(counts):
        asked = {k: int(s * (1 << BITS)) if s < 1 else (1 << BITS) - 1 for k, s in share.items() if k not in out}
        passing = narrow.where(F.col("__h") <= _limit(None if label is None else F.col("__label"), asked))
        found: dict[Hashable, list[tuple[int, int]]] = {k: [] for k in asked}
        for r in passing.groupBy("__label", "__h").agg(F.max("__size").alias("__size")).collect():
            found[r["__label"] if label is not None else next(iter(asked))].append((r["__h"], r["__size"]))
        for k, v in found.items():
            if len(v) >= n or share[k] >= 1:
                out[k] = sorted(v)[:n]
            share[k] = min(1.0, share[k] * WIDER)
    return out


def sample_rows(rows: DataFrame, keys: Sequence[str | Column], counts: Mapping[Hashable, int], n: int, label: str | None = None, passes: Mapping[Hashable, int] | None = None) -> DataFrame:
    """``rows`` with the ``n`` smallest keys of each label, one row a key. ``passes`` may give the largest hash of each label instead."""
    if passes is None:
        passes = {k: v[-1][0] for k, v in smallest_keys(rows, keys, counts, n, label).items() if v}
    if not passes:
        return rows.limit(0)
    some = rows.withColumn("__h", key_hash(*keys)).where(F.col("__h") <= _limit(None if label is None else F.col(label), passes))
    # Tasks merge repeated rows before any shuffle.
    grouped = some.groupBy(*([label] if label else []), "__h").agg(F.first(F.struct(*rows.columns)).alias("__row"))
    return grouped.select("__row.*")
