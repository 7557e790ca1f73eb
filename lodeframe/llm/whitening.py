"""Embedding whitening with exact sums, by digit-slice matrix products.

Entries are turned into integers x, and the fit list holds each distinct x vector once. With n of them and per-dimension sums S,
y = n * x - S is centred without rounding. A block of at most ``BLOCK`` vectors y is split into limbs of ``BITS`` bits, so
that every float64 product of two limb matrices is a sum of at most 2^53 and hence exact. Products are recombined as
big integers, which leave a task once as 40-bit words in long columns; words are summed by an aggregate over (i, j), so that
what reaches the driver grows with the square of the dimension and not with the rows. There the sums become the covariance
(sum of y y^T) / n^3, each entry rounded once, and its eigenvectors.

Rows whose vector is null, or has null or non-finite entries, are dropped. So are empty vectors, and vectors that don't have the
most frequent length (ties: the longest). Entries beyond 64 bits are the nearest long. Directions without variance (an eigenvalue
of rounding errors only) can't be whitened and are left out, so equal vectors, or a single one, give no rows. Repeated ids and
null ids are rows like any other; the distinct list merges repeated vectors in their tasks before it shuffles. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.plans.scratch import materialize

#: Bits of a limb and vectors of a block: 2 * BITS + log2(BLOCK) is at most 53.
BITS, BLOCK = 20, 4096
#: Bits and number of the words that big integers are summed in; the last one holds all that is left.
WORD, WORDS = 40, 6


class Model(NamedTuple):
    n: int
    sums: list[int]
    #: One row a component: the unit eigenvector over the root of its eigenvalue.
    axes: np.ndarray
    values: np.ndarray
    trace: float


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * entry) as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def integer_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, x array<long>) of the usable rows that have the most frequent length."""
    rows = df.where(usable(F.col(vector_col)))
    size = F.size(vector_col)
    sizes = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(size == (sizes[0]["d"] if sizes else 0))
    return rows.select(id_col, integers(F.col(vector_col), scale).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as longs where they are sure to hold it and as big integers elsewhere."""
    most = n * max(1, abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(s) for s in sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Float matrices of ``BITS``-bit limbs, lowest first; the highest one has the sign."""
    bits = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))).bit_length() + 1
    n = -(-bits // BITS)
    return [((y >> (BITS * k)) & ((1 << BITS) - 1) if k < n - 1 else y >> (BITS * k)).astype(np.float64) for k in range(n)]


def gram(y: np.ndarray) -> np.ndarray:
    """The sum of the outer products of the rows of ``y``, as big integers."""
    parts, out = limbs(y), np.zeros((y.shape[1], y.shape[1]), object)
    for k, a in enumerate(parts):
        for m, b in enumerate(parts[: k + 1]):
            product = (a.T @ b).astype(np.int64)
            out += (product if k == m else product + product.T).astype(object) << (BITS * (k + m))
    return out


def squares(y: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, as longs or big integers."""
    if y.dtype != object and y.shape[1] * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 < 1 << 63:
        return (y * y).sum(1)
    parts, out = limbs(y), np.zeros(len(y), object)
    for k, a in enumerate(parts):
        for m, b in enumerate(parts[: k + 1]):
            product = np.einsum("ij,ij->i", a, b).astype(np.int64).astype(object)
            out += (product if k == m else 2 * product) << (BITS * (k + m))
    return out


def words(values: np.ndarray) -> list[pa.Array]:
    """Big integers as columns of 40-bit words."""
    mask = (1 << WORD) - 1
    return [pa.array([(v >> (WORD * k)) & mask if k < WORDS - 1 else v >> (WORD * k) for v in values.tolist()], pa.int64()) for k in range(WORDS)]


def _totals(rows: DataFrame, keys: list[str]) -> list[tuple]:
    """(keys, big integer) summed over tasks; as many rows as there are keys reach the driver."""
    total = rows.groupBy(*keys).agg(*(F.sum(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    return [(*(r[k] for k in keys), sum(r[f"w{k}"] << (WORD * k) for k in range(WORDS))) for r in total.collect()]


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            part = whole.slice(at, BLOCK)
            yield part, matrix(part.column(column))


WORD_COLUMNS = ", ".join(f"w{k} long" for k in range(WORDS))
WORD_NAMES = [f"w{k}" for k in range(WORDS)]


def vector_sums(fit: DataFrame) -> list[int]:
    """Exact sums of each dimension of column ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            own = sum(p.sum(0).astype(np.int64).astype(object) << (BITS * k) for k, p in enumerate(limbs(x)))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *words(total)], names=["i", *WORD_NAMES])

    return [v for _, v in sorted(_totals(fit.select("x").mapInArrow(run, f"i int, {WORD_COLUMNS}"), ["i"]))]


def centred_gram(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The exact sum of y y^T over the rows of column ``x``, as big integers."""
    d = len(sums)
    i, j = np.tril_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for _, x in _blocks(batches, 0):
            total += gram(centred(x, n, sums))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *words(total[i, j])], names=["i", "j", *WORD_NAMES])

    out = np.zeros((d, d), object)
    for a, b, v in _totals(fit.select("x").mapInArrow(run, f"i int, j int, {WORD_COLUMNS}"), ["i", "j"]):
        out[a, b] = out[b, a] = v
    return out


def fit_whitening(fit: DataFrame, components: int = 4) -> Model | None:
    """The model of a table of distinct vectors ``x``; None where it is empty."""
    n = fit.count()
    if not n:
        return None
    sums = vector_sums(fit)
    moments = centred_gram(fit, n, sums)
    # Quotients of integers are rounded once.
    covariance = np.array([[v / n**3 for v in row] for row in moments.tolist()], float)
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(-values, kind="stable")[:components]
    top = top[values[top] > max(0.0, values.max()) * len(sums) * np.finfo(float).eps]
    trace = sum(moments[k, k] for k in range(len(sums))) / n**3
    return Model(n, sums, vectors[:, top].T / np.sqrt(values[top])[:, None], values[top], trace)


def whiten(rows: DataFrame, model: Model, id_col: str = "vec_id") -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of rows (id, x): the exact sum of (n x - S)^2 (null where it has
    more than 38 digits), and the centred vector on each whitened component."""
    kind = rows.schema[id_col].dataType.simpleString()
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            y = centred(x, model.n, model.sums)
            found = squares(y)
            found = [v if v < 10**38 else None for v in found.tolist()] if found.dtype == object else found
            deviation = pa.array(found, None if isinstance(found, np.ndarray) else exact).cast(exact)
            out = (y / model.n).astype(float) @ model.axes.T
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[id_col, "deviation", "whitened"])

    return rows.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity; tasks merge centred moments."""
    k = len(model.values)
    if not k:
        return 0.0
    own = whiten(fit.withColumn("id", F.lit(0)), model, "id").select(*(F.get("whitened", F.lit(i)).alias(f"c{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = own.agg(*(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"v{i}_{j}"] - (i == j)) for i, j in pairs)


def embedding_whitening(df: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    rows = integer_rows(df, id_col, vector_col, scale)
    fit = materialize(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, components)
    if model is None:
        model = Model(1, [], np.zeros((0, 0)), np.zeros(0), 1.0)
    error = identity_error(fit, model)
    share = F.lit([float(v / model.trace) for v in model.values]).cast("array<double>")
    whitened = whiten(rows, model, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return whitened.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
