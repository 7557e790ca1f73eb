"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from the frequencies of its pairs of character classes
and from word statistics; gated attention weighs the passages, with weights learned from document labels alone;
the weighted representation is scored. The network is trained on a bounded sample of labelled documents, of which those
with more than ``BAG`` passages give that many, evenly spaced, and is a few thousand numbers. Documents are scored
where they lie, every passage of the whole text, in one pass without a shuffle.

Null and empty texts are one empty passage. Where there are no labels every score is 0.5. Rows are independent, so
repeated rows and ties need nothing special. A document with two labels is learned from with both; rows that repeat id, text
and label count once. Rows with a null id have no label. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeframe.llm.sampling import sample_rows, smallest_keys

#: Characters of a passage; bounds of the training sample in documents, passages of one document and passages in all
#: (3 KB each on the driver); rows and passages handled at once.
PASSAGE, SAMPLE, BAG, PASSAGES, ROWS, BLOCK = 1000, 6_000, 64, 40_000, 256, 200
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 30, 64, 3e-3
#: One class each for these characters; letters, digits, spaces and the rest have classes by kind.
SINGLE = "\n.,!?:;'\"-_/=()[]{}#*$%&|<>@\\+~^"
KINDS = len(SINGLE) + 8


def _classes() -> np.ndarray:
    table = np.zeros(0x600, np.uint16)
    for i in range(len(table)):
        c = chr(i)
        if c in SINGLE:
            table[i] = SINGLE.index(c)
        else:
            kind = 0 if c == " " else 1 if c.isspace() else 2 if "a" <= c <= "z" else 3 if c.islower() else 4 if c.isupper() else 5 if c.isdigit() else 6 if c.isalpha() else 7
            table[i] = len(SINGLE) + kind
    return table


CLASSES = _classes()
STATS = 8
FEATURES = KINDS * KINDS + STATS


def _repeated(found: list[np.ndarray]) -> np.ndarray:
    """Per passage, the share of its hashes that an earlier passage has too; whatever their number."""
    sizes = np.array([len(x) for x in found])
    hashes, first, back = np.unique(np.concatenate(found), return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(found)), sizes)
    return np.bincount(owner, owner[first][back] < owner, len(found)) / np.maximum(1, sizes)


def encode(text: str | None) -> Iterator[np.ndarray]:
    """Feature rows of the passages, in blocks of a bounded number of passages.

    What is kept for the whole text is 8 bytes a word, so that repeats are seen at any distance.
    """
    text = text or ""
    n = max(1, -(-len(text) // PASSAGE))
    stats, threes, lines = np.zeros((n, STATS), np.float32), [], []
    for i in range(n):
        own = text[i * PASSAGE : (i + 1) * PASSAGE]
        words = own.split()
        rows = [hash(s) for s in own.split("\n") if s.strip()]
        windows = np.fromiter(map(hash, zip(words, words[1:], words[2:])), np.int64)
        fresh = np.unique(windows)
        m = max(1, len(words))
        threes.append(fresh)
        lines.append(np.array(rows, np.int64))
        stats[i] = len(set(words)) / m, len(fresh) / max(1, len(windows)), 0, 0, len(own) / m / 10, len(own) / PASSAGE, np.log1p(len(rows)), np.log1p(len(text)) / 10
    if n > 1:
        stats[:, 2], stats[:, 3] = _repeated(threes), _repeated(lines)
    for at in range(0, n, BLOCK):
        part = text[at * PASSAGE : (at + BLOCK) * PASSAGE]
        x = np.zeros((min(BLOCK, n - at), FEATURES), np.float32)
        k = CLASSES[np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), len(CLASSES) - 1)].astype(np.int64)
        if len(k) > 1:
            pairs = k[:-1] * KINDS + k[1:] + (np.arange(len(k) - 1) // PASSAGE) * KINDS * KINDS
            x[:, : KINDS * KINDS] = np.sqrt(np.bincount(pairs, minlength=len(x) * KINDS * KINDS).reshape(len(x), -1) / PASSAGE)
        x[:, -STATS:] = stats[at : at + BLOCK]
        yield x


def _spaced(text: str | None, most: int) -> bytes:
    """Half-precision features of at most ``most`` passages, evenly spaced over the text."""
    n = max(1, -(-len(text or "") // PASSAGE))
    wanted, at, out = np.unique(np.arange(most) * n // most) if n > most else np.arange(n), 0, []
    for x in encode(text):
        out.append(x[wanted[(wanted >= at) & (wanted < at + len(x))] - at].astype("<f2").tobytes())
        at += len(x)
    return b"".join(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Encoder, gated attention and scorer, with their gradients."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (draw.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k in "ac" else np.zeros(s)) for k, s in shapes.items()}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representations and unnormalised attention of passages."""
        h = np.tanh((x - self.mean) * self.scale @ self.p["w"] + self.p["b"])
        return h, np.tanh(h @ self.p["v"]) * _sigmoid(h @ self.p["u"]) @ self.p["a"]

    def score(self, text: str | None) -> float:
        """Streams over blocks of passages: the attention sums are rescaled as in a running softmax."""
        top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in encode(text):
            h, e = self.passages(x)
            peak = max(top, float(e.max()))
            w = np.exp(e - peak)
            keep = np.exp(top - peak)
            z, total, top = z * keep + w @ h, total * keep + w.sum(), peak
        return float(_sigmoid(z / total @ self.p["c"] + self.p["d"][0]))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss, for bags that begin at ``starts`` in the rows of ``x``."""
        p = self.p
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        n = (x - self.mean) * self.scale
        h = np.tanh(n @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = t * s @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        out = (_sigmoid(z @ p["c"] + p["d"][0]) - y) / len(y)
        dz = out[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dts = de[:, None] * p["a"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
        dn = dh * (1 - h * h)
        return {"w": n.T @ dn, "b": dn.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ out, "d": np.array([out.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam with weight decay over shuffled batches of bags."""
    total, squares, n = np.zeros(FEATURES), np.zeros(FEATURES), 0
    for bag in bags:
        total, squares, n = total + bag.sum(0, dtype=float), squares + (bag.astype(float) ** 2).sum(0), n + len(bag)
    mean = total / n
    net = Network(mean, 1 / (np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 0.05))
    draw = np.random.default_rng(5)
    m, v, turn = {k: 0 * x for k, x in net.p.items()}, {k: 0 * x for k, x in net.p.items()}, 0
    for _ in range(epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            starts = np.cumsum([0, *(len(bags[i]) for i in own[:-1])])
            turn += 1
            for k, g in net.gradients(np.concatenate([bags[i] for i in own]).astype(np.float32), starts, labels[own]).items():
                g = g + 1e-4 * net.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    return net


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bag: int = BAG, passages: int = PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network | None:
    """Network from a sample of the labelled documents; None without labels.

    The sample holds ``sample`` documents at most, ``bag`` passages of each and ``passages`` in all, so what the driver collects
    does not grow with the texts; a document that is alone over ``passages`` isn't learned from.
    """
    labels = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    # At most ``sample`` labels, so they may be broadcast; documents that repeat an id are drawn again below.
    some = sample_rows(labels, ["__id", "__y"], {"": labels.count()}, sample)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__t")).join(F.broadcast(some), docs[id_col] == F.col("__id")).select("__id", "__y", "__t")
    size = F.least(F.lit(bag), F.ceil(F.greatest(F.coalesce(F.length("__t"), F.lit(0)), F.lit(1)) / PASSAGE))
    last, total = None, 0
    for h, n in smallest_keys(rows, ["__id", "__y", "__t"], {"": rows.count()}, sample, size=size)[""]:
        total += n
        if total > passages:
            break
        last = h
    if last is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                found = [_spaced(t, bag) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["y", "x"])

    rows = sample_rows(rows, ["__id", "__y", "__t"], {}, sample, passes={"": last}).select("__y", "__t")
    taken = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(run, "y double, x binary").collect())
    return fit([np.frombuffer(x, "<f2").reshape(-1, FEATURES) for _, x in taken], np.array([y for y, _ in taken]))


def score_quality(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                scores = [net.score(t) if net else 0.5 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double")
