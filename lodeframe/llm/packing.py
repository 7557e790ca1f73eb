"""Packing into sequences by cutting-stock column generation.

Documents are tokenized where they lie and cut into full sequences, then the largest multiple of a block, then a
tail. Pieces are counted in a length histogram of at most ``capacity / WIDTH`` bins, whatever the corpus. On that
histogram a linear program over cutting patterns is solved by column generation (a knapsack dynamic program
prices columns, down to a gap of GAP), the patterns are rounded down, and what is left, at most a few pieces a bin,
is packed best-fit decreasing. Pieces are ranked in their bins in parallel (salted, then shifted by the counts of smaller salts) and
take the slots that the patterns have for those ranks. No tokens are shuffled.

Ids are those of the ``tokenizers`` file. ``tiktoken`` reads the same vocabulary five times as fast and gives the same
ids, but its pattern engine refuses runs of about a million blanks; such texts go to ``tokenizers`` itself.

A null or empty text is the end token alone. Rows that repeat a doc_id are packed one by one. An empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodeframe.llm.bpe import byte_symbols
from lodeframe.plans.scratch import materialize

WIDTH, ROWS, SALTS, SALT_ROWS = 4, 256, 64, 50_000
MAX_ROUNDS, RENEW, GAP = 4_000, 250, 2e-3


class ByteBpe:
    """Byte-level BPE of a ``tokenizers`` file; added tokens inside a text are those tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32)
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, block: int = 512, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece: full sequences, a multiple of ``block``, the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(vocabulary, pattern)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = np.concatenate([encoding.encode(t), end]) if t else end
                    cuts = [*range(0, len(found), capacity), len(found)]
                    if (tail := (cuts[-1] - cuts[-2]) % block) and cuts[-1] - cuts[-2] > block:
                        cuts.insert(-1, len(found) - tail)
                    for a, b in zip(cuts, cuts[1:]):
                        own = found[a:b]
                        row.append(i)
                        start.append(a)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                        total.append(len(found))
                        if with_ids:
                            ids.append(own.astype(np.int64))
                arrays = [part.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a sequence and how often it takes each of the ascending ``sizes``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            with_item = best[c - sizes[:k]] + values[:k]
            i = int(with_item.argmax())
            if with_item[i] > best[c]:
                best[c], pick[c] = with_item[i], i
    takes, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            takes[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[capacity], takes


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product without threads: the matrices are small, and idle threads of the driver cost more than they give."""
    return np.einsum("ij,jk->ik", a, b)


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their (fractional) numbers: the least number of sequences that holds ``demand`` pieces of each size."""
    columns = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / (capacity // sizes)), demand / (capacity // sizes)
    least = demand @ sizes / capacity
    for turn in range(1, MAX_ROUNDS):
        duals = inverse.sum(0)
        value, column = knapsack(sizes, duals, capacity)
        if x.sum() <= (1 + GAP) * max(least, x.sum() / value):
            break
        step = (inverse * column).sum(1)
        ratio = np.divide(x, step, out=np.full(len(x), np.inf), where=step > 1e-9)
        i = int(ratio.argmin())
        if not np.isfinite(ratio[i]):
            break
        x = np.maximum(x - ratio[i] * step, 0)
        x[i] = ratio[i]
        columns[:, i] = column
        pivot = inverse[i] / step[i]
        inverse -= np.outer(step, pivot)
        inverse[i] = pivot
        if turn % RENEW == 0:
            # One Newton step takes the rounding errors out of the inverse.
            inverse = 2 * inverse - _times(_times(inverse, columns), inverse)
            x = np.maximum((inverse * demand).sum(1), 0)
    return columns, x


def plan_sequences(demand: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(size, count), ...])] that places exactly ``demand`` pieces of each size (1 to capacity)."""
    out, left = [], {}
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0 and s < capacity), int)
    if demand.get(capacity):
        out.append((demand[capacity], [(capacity, 1)]))
    if len(sizes):
        want = np.array([demand[s] for s in sizes], float)
        columns, x = generate_patterns(sizes, want, capacity)
        rest = want.astype(int)
        for i in np.argsort(-x, kind="stable"):
            takes = columns[:, i].astype(int)
            times = min(int(x[i] + 1e-6), int((rest[takes > 0] // takes[takes > 0]).min(initial=1 << 60)))
            if times > 0:
                rest -= times * takes
                out.append((times, [(int(sizes[k]), int(takes[k])) for k in np.flatnonzero(takes)[::-1]]))
        left = {int(s): int(n) for s, n in zip(sizes, rest) if n}
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    made: list[dict[int, int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            space = next((r for r in range(size, capacity) if room[r]), capacity)
            if space == capacity:
                made.append({})
            which = room[space].pop() if space < capacity else len(made) - 1
            made[which][size] = made[which].get(size, 0) + 1
            room[space - size].append(which)
    return out + [(1, sorted(m.items(), reverse=True)) for m in made]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per size, rows (first rank, first sequence, pieces of this size in a sequence, first slot) by ascending rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, takes in plan:
        slot = 0
        for size, count in takes:
            out.setdefault(size, []).append((ranks.get(size, 0), sequence, count, slot))
            ranks[size] = ranks.get(size, 0) + times * count
            slot += count
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def place(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``pieces`` with sequence_id and offset; ``cut`` is read more than once, so pass a table."""
    size = F.ceil(F.col("length") / WIDTH).cast("int")
    total = cut.count()
    salts = max(SALTS, total // SALT_ROWS)
    rows = cut.withColumns({"__size": size, "__salt": F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts))})
    counts = materialize(rows.groupBy("__size", "__salt").agg(F.count("*").alias("n")), "histogram")
    demand = {r[0]: r[1] for r in counts.groupBy("__size").agg(F.sum("n")).collect()}
    table = slots(plan_sequences(demand, capacity // WIDTH))
    before = Window.partitionBy("__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__size", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    own = Window.partitionBy("__size", "__salt").orderBy(id_col, "start", "ids_crc32", "doc_tokens")
    ranked = rows.withColumn("__rank", F.row_number().over(own)).join(shift, ["__size", "__salt"])
    ranked = ranked.select(*cut.columns, "__size", (F.col("__rank") - 1 + F.col("__shift")).alias("__rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            sequence, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                own = np.flatnonzero(sizes == s)
                first = table[int(s)]
                at = first[np.searchsorted(first[:, 0], rank[own], side="right") - 1]
                j = rank[own] - at[:, 0]
                sequence[own], slot[own] = at[:, 1] + j // at[:, 2], at[:, 3] + j % at[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(slot)], names=[*batch.schema.names[:-2], "sequence_id", "__slot"])

    placed = ranked.mapInArrow(run, f"{kinds}, sequence_id long, __slot long")
    inside = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("__slot")


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) of every piece of every document."""
    cut = materialize(pieces(docs, vocabulary, pattern, capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    return place(cut, capacity, id_col)
