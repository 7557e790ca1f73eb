"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of features. Document frequencies come from
all labelled rows; the regression is trained on a bounded sample of them (``per_lang`` rows of each language,
fewer where there are many languages or rows; see ``sampling``) with follow-the-regularised-leader and elastic-net penalties, and a
temperature is then fitted on a part of the sample that training does not see. The model is a table of
features by languages; documents are scored where they lie, in one pass without a shuffle.

Null texts and texts without a letter are ``und`` with score 0; so is every text where nothing was labelled.
Rows are independent, so repeated rows and ties need nothing special (equal scores: the first language by name).
Long texts are read in stretches, which bounds memory. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.llm.sampling import sample_rows

BITS, ORDERS, STRETCH, ROWS = 14, 3, 1 << 18, 512
PER_LANG, SAMPLE = 800, 6_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased text."""
    out = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for at in range(0, len(text), STRETCH):
        c = np.frombuffer(text[at : at + STRETCH + ORDERS - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(STRETCH, len(c))
        h = np.zeros(len(c), np.uint32)
        for order in range(ORDERS):
            if len(c) <= order:
                break
            h = h[: len(c) - order] * np.uint32(0x01000193) + c[order:] + np.uint32(order + 1)
            out += np.bincount((h[:own] * np.uint32(0x9E3779B1)) >> shift, minlength=1 << bits)
    return out


def _tf(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    return at, 1 + np.log(counts[at])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows, and their number; tasks add up before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.column(0).slice(at, ROWS).to_pylist():
                    df[np.flatnonzero(ngram_counts(t))] += 1
                    n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["f", "n"])

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).mapInArrow(run, "f int, n long")
    df = np.zeros((1 << BITS) + 1, np.int64)
    for f, n in rows.groupBy("f").agg(F.sum("n").alias("n")).collect():
        df[f] = n
    return df[:-1], int(df[-1])


def _sample(labelled: DataFrame, langs: dict[str, int], id_col: str, text_col: str, lang_col: str, per_lang: int) -> list:
    """(lang, part 0 to 4, features, term frequencies) of a bounded sample, by hash of id and text."""
    most = min(per_lang, max(20, SAMPLE // max(1, len(langs))))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    taken = sample_rows(rows, ["lang", "id", "text"], langs, most, "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_tf(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()), pa.array([tf.astype("<f4").tobytes() for _, tf in found], pa.binary()),
            ], names=["lang", "part", "at", "tf"])

    part = F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(5)).cast("int")
    rows = taken.select("lang", part, "text").mapInArrow(run, "lang string, part int, at binary, tf binary")
    return sorted((r["lang"], r["part"], bytes(r["at"]), bytes(r["tf"])) for r in rows.collect())


def ftrl(examples: list, n_langs: int, epochs: int = 3, rate: float = 0.5, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (label, features, values): one per-coordinate update for each example; the last feature is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, n_langs)), np.zeros((size, n_langs))

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0, (np.sign(zs) * l1 - zs) / ((1 + np.sqrt(n[at])) / rate + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            label, at, x = examples[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a fixed grid."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    return float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()))


def train_language_id(labelled: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from rows with a text and a non-null language; None where there are no such rows."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not langs:
        return None
    names = sorted(langs)
    df, n = document_frequencies(labelled, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    train, held = [], []
    for lang, part, at, tf in _sample(labelled, langs, id_col, text_col, lang_col, per_lang):
        at = np.frombuffer(at, "<i4")
        x = np.frombuffer(tf, "<f4") * idf[at]
        (train if part else held).append((names.index(lang), at, x / max(1e-9, np.sqrt(x @ x))))
    w, b = ftrl(train, len(names))
    logits = np.array([x @ w[at] + b for _, at, x in held]).reshape(-1, len(names))
    t = calibrate(logits, np.array([k for k, _, _ in held], int))
    return Model(names, w.astype(np.float32), b.astype(np.float32), idf.astype(np.float32), t)


def predict_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred and score added (input columns of those names are replaced)."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score") or c == id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                langs, scores = [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    if model is None or not t or not LETTER.search(t):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at, tf = _tf(t)
                    x = tf * model.idf[at]
                    p = softmax((x @ model.weights[at] / np.sqrt(x @ x) + model.bias) / model.temperature)
                    langs.append(model.langs[int(p.argmax())])
                    scores.append(min(1.0, float(p.max())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    rows = docs.select(*(f"`{c}`" for c in rest), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
