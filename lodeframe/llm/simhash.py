"""SimHash near-duplicates: fingerprints, an inverted index over byte positions with count filtering, components.

Two fingerprints of 8 bytes that differ in at most ``d`` bits share at least ``8 - d`` of their positional bytes.
A plain list per (position, byte) would tally a share of all pairs that grows with the square of the corpus, so the
index is keyed by sets of ``7 - d`` positions, one fewer than are sure to be shared: a linked pair meets in at least
``C(8 - d, 7 - d)`` lists (6 of 56 at two bits), the guaranteed minimum of the count filter. Pairs are tallied over
the whole index, those below the minimum are rejected (they share one set by chance), and the bits of the rest are
verified.

A list of more than ``SMALL`` fingerprints forms no pairs: each looks up the few values within ``d`` bits of it that
are in the list, and only those are tallied. All lists where a linked pair meets count it, so none is lost. A list
holds at most 256**(d + 1) distinct fingerprints (134 MB at two bits), whatever the size of the corpus, and a
fingerprint has at most 2080 others within two bits.

Exact copies share a fingerprint and enter the index once. Components come from alternating large-star and
small-star rounds over tables in the shared folder.

A null or empty text, or one without a word, has fingerprint zero and is linked like any other. Rows that repeat a
doc_id are separate members with one id; null ids are members too, and a component of null ids alone has a null id.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodeframe.operators.graph import components
from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key

BYTES, SMALL, ROWS = 8, 32, 1024
#: Shingles hashed at once.
PART = 1 << 16
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over shingles of ``width`` words; A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    total, ones = 0, np.zeros(64, np.int64)
    shingles = iter(shingles)
    while len(h := np.fromiter(_take(shingles, PART), np.uint64)):
        total += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _take(shingles: Iterator[bytes], n: int) -> Iterator[int]:
    return map(xxhash.xxh64_intdigest, islice(shingles, n), repeat(SEED))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row: the unsigned fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                fps = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def pairs_of(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(larger, smaller) of all pairs within the rows of a matrix, one list a row."""
    i, j = np.triu_indices(lists.shape[1], 1)
    x, y = lists[:, i].ravel(), lists[:, j].ravel()
    return np.maximum(x, y), np.minimum(x, y)


def neighbours(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(larger, smaller) of the pairs within ``bits`` bits among sorted distinct ``fps``, by look-up of changed values."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    single = [1 << b for b in range(64) if varying >> b & 1]
    for k in range(1, bits + 1):
        for flip in combinations(single, k):
            other = fps ^ np.uint64(sum(flip)).view(np.int64)
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            found = (fps[at] == other) & (other < fps)
            if found.any():
                yield fps[found], other[found]


def tally(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b, n), b the smaller: in how many lists of the index the fingerprints a and b of column ``fp`` meet.

    Pairs whose lists all are large are only those within ``bits`` bits.
    """
    sets = list(combinations(range(BYTES), max(1, BYTES - bits - 1)))
    keys = F.array(*(F.struct(F.lit(i).cast("byte").alias("positions"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("shared")) for i, s in enumerate(sets)))
    index = distinct.select("fp", F.explode(keys).alias("k"))
    lists = index.groupBy("k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for n in np.unique(sizes):
                starts = ends[sizes == n] - n
                if n <= SMALL:
                    found = [pairs_of(flat[starts[:, None] + np.arange(n)])]
                else:
                    found = (pair for at in starts for pair in neighbours(np.sort(flat[at : at + n]), bits))
                for a, b in found:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b), b the smaller, of the distinct column ``fp`` within ``bits`` bits of each other: tallied, retained, verified."""
    retained = tally(distinct, bits).where(F.col("n") >= comb(BYTES - bits, max(1, BYTES - bits - 1)))
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def near_duplicates(docs: DataFrame, bits: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component) of every row; component is the smallest id reachable over links, its own included."""
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    reached = components(links(distinct.select("fp"), bits))
    # Fingerprints are ordered as numbers in components(); documents by their smallest id per component.
    labelled = distinct.join(reached, distinct.fp == reached.node, "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("c"))
    labelled = materialize(labelled, "labelled")
    lowest = materialize(labelled.groupBy("c").agg(F.min("low").alias("component"), F.count("*").alias("m")), "lowest")
    of_fp = materialize(join_per_key(labelled, lowest, "c", "m", total).select("fp", "n", "component"), "components")
    return join_per_key(fps, of_fp, "fp", "n", total).select(id_col, "fp", "component")


def unsigned_hex(fp: str):
    """16 lower-case hex digits of a long column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
