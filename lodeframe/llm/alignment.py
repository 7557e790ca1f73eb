"""Cross-tokenizer alignment: which tokens of two vocabularies spell the same bytes.

Both tokenizations spell a blank and the text. A task concatenates the texts of a block of an Arrow batch, so that a byte of
any of them has one offset in the block, bincounts the ends of A and B tokens once, and cuts where both occur; prefix sums over
cuts and links, read at the borders of the texts, give what each text has. A token's group is the number of cuts before it.

The links of a group are all its pairs of an A and a B token. They leave a task as distinct id pairs of a text with the
number of their links, never one by one. Pairs are counted over the corpus by an aggregate that merges in tasks first, and the
counts come back by ``join_per_key``: pairs with a fixed share of all rows, a bounded number, are broadcast and the others
shuffled. Best counts per A id are at most one row an entry of A's vocabulary.

A is a byte-level BPE file, of which ``tiktoken`` reads the words that ``splitting`` finds, very long ones apart, by
``prefix_bpe``. B is a sentencepiece BPE model with byte fallback, read by its library in stretches between places that no piece
crosses (``token_counts`` says which). Each Python worker keeps bounded tables of short words and stretches.

Null and empty texts, and texts that a tokenization doesn't spell out (those with U+2581), have no tokens. Rows are
told apart by a number of their own, so repeated rows and null ids count one by one. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from lodeframe.llm.bpe import byte_symbols
from lodeframe.llm.prefix_bpe import Prefixes, Words
from lodeframe.llm.splitting import Splitter
from lodeframe.llm.token_counts import LETTER, LONG, MARK, UNIT
from lodeframe.plans.scratch import materialize
from lodeframe.plans.skew import join_per_key

#: Words and stretches kept per Python worker, texts and characters of a block, pairs formed at once, and characters of a very
#: long word.
MAX_WORDS, MAX_UNITS, ROWS, CHARS, PAIRS, HUGE = 100_000, 100_000, 256, 1 << 19, 1 << 21, 2_000
#: An id pair is one number: A's id times this, and B's id.
SHIFT = 1 << 32
#: A pair is broadcast with its count if it has one part in so many of all rows: at most 4 MB of numbers.
HOT_SHARE = 100_000


class BytePieces:
    """A: ids and byte strings of a byte-level ``tokenizers`` file; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split, self.ranks, self.words = Splitter(pattern), ranks, Words(self.word, MAX_WORDS)
        self.bytes = np.full(max(ranks.values()) + 1, b"", object)
        for t, i in ranks.items():
            self.bytes[i] = t

    @cached_property
    def prefixes(self) -> Prefixes:
        return Prefixes(self.ranks)

    def word(self, word: str) -> bytes:
        """Packed ids of one word. The library's pattern engine gives up on very long runs, and its time grows faster than they do."""
        ids = self.library.encode_ordinary(word) if len(word) <= HUGE else self.prefixes.tokens(word.encode())
        return array("i", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids."""
        look = self.words.__getitem__
        return [b"".join(map(look, self.split(t))) for t in texts]


class MarkedPieces:
    """B: ids and byte strings of a sentencepiece BPE model that puts a mark in front of the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a mark in front is needed")
        normal = [p.piece for p in model.pieces if p.type == 1]
        if any(p.type == 4 for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("user-defined pieces, and pieces with a mark inside, are not supported")
        if any((LETTER.match(a) is None) != (LETTER.match(b) is None) for p in normal for a, b in zip(p, p[1:]) if a != MARK):
            raise ValueError("pieces that join Latin letters and other characters are not supported")
        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = np.array([bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in model.pieces], object)
        self.units: dict[str, bytes] = {}
        #: What is read in front of a stretch without a mark: no piece joins it, and its own ids are left out.
        self.fronts = [(c, len(self.library.encode(c))) for c in "a0"]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Packed ids of stretches."""
        asked, less = [], []
        for u in units:
            # The library puts the first mark there, unless there is nothing else.
            front, n = ("", 0) if u[0] == MARK and u != MARK else self.fronts[LETTER.match(u) is not None]
            asked.append(front + (u if front else u[1:]).replace(MARK, " "))
            less.append(n)
        found = self.library.encode(asked, num_threads=1)
        return {u: array("i", ids[n:] if n else ids).tobytes() for u, ids, n in zip(units, found, less)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of texts without a mark."""
        rows = [UNIT.findall(MARK + t.replace(" ", MARK)) for t in texts]
        seen = set().union(*rows)
        fresh = seen - self.units.keys()
        if len(self.units) + len(fresh) > MAX_UNITS:
            self.units.clear()
            fresh = seen
        learned = self._learn(list(fresh))
        self.units.update((u, ids) for u, ids in learned.items() if len(u) <= LONG)
        look = {**self.units, **learned} if any(len(u) > LONG for u in fresh) else self.units
        return [b"".join(map(look.__getitem__, row)) for row in rows]


def first_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive stretches of these sizes begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)])


class Block:
    """The alignment of a block of texts, given the packed ids of each."""

    def __init__(self, packed_a: list[bytes], packed_b: list[bytes], length_a: np.ndarray, length_b: np.ndarray):
        self.a, self.b = (np.frombuffer(b"".join(p), np.int32).astype(np.int64) for p in (packed_a, packed_b))
        self.n_a, self.n_b = (np.array([len(x) // 4 for x in p], np.int64) for p in (packed_a, packed_b))
        self.end_a, self.end_b = np.cumsum(length_a[self.a]), np.cumsum(length_b[self.b])
        size = int(self.end_a[-1]) if len(self.a) else 0
        self.cut = np.bincount(np.concatenate([self.end_a, self.end_b]), minlength=size + 1) == 2
        before = np.cumsum(self.cut, dtype=np.int32)
        #: The group of each token.
        self.group_a, self.group_b = before[self.end_a - 1], before[self.end_b - 1]
        groups = int(before[-1])
        self.per_a, self.per_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        #: The first group of each text, and one more.
        self.text_groups = before[np.concatenate([[0], self.end_a])[first_of(self.n_a)]].astype(np.int64)
        self.n_groups = np.diff(self.text_groups)
        self.n_links = np.diff(first_of(self.per_a * self.per_b)[self.text_groups])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pair, links) of the distinct id pairs of each text, sorted by text; a pair is in one chunk only."""
        (ga, a, na), (gb, b, nb) = self._tokens(self.group_a, self.a), self._tokens(self.group_b, self.b)
        per_b = np.bincount(gb, minlength=len(self.per_b))
        first_b, each = first_of(per_b), per_b[ga]
        if not len(a):
            return
        size_a, size_b = int(a.max()) + 1, int(b.max()) + 1
        # Chunks by A id bound what is formed at once, whatever the size of a group.
        weight = np.bincount(a, each)
        chunk = (np.cumsum(weight) // PAIRS).astype(np.int64)[a]
        text_of = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        for c in np.unique(chunk):
            at = np.flatnonzero(chunk == c)
            times = each[at]
            left = np.repeat(at, times)
            right = np.arange(len(left)) - np.repeat(first_of(times)[:-1] - first_b[ga[at]], times)
            # One number for text, A and B id.
            key = (text_of[ga[left]] * size_a + a[left]) * size_b + b[right]
            order = np.argsort(key, kind="stable")
            key, links = key[order], (na[left] * nb[right])[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rest, own_b = np.divmod(key[new], size_b)
            text, own_a = np.divmod(rest, size_a)
            yield text, own_a * SHIFT + own_b, np.add.reduceat(links, new)

    @staticmethod
    def _tokens(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, number): tokens by group; in groups of more than a few, equal ids become one."""
        if not len(ids) or np.bincount(group).max() <= 8:
            return group, ids, np.ones(len(ids), np.int64)
        key, n = np.unique(group.astype(np.int64) * SHIFT + ids, return_counts=True)
        return key // SHIFT, key % SHIFT, n

    def texts_of_groups(self, table: np.ndarray, size_a: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text; ``table`` as made by ``group_table``."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + first_of(self.per_b)[self.group_a]] = 2 * self.a + self.cut[self.end_a]
        out[np.arange(len(self.b)) + first_of(self.per_a)[self.group_b + 1]] = 2 * (size_a + self.b) + self.cut[self.end_b]
        shown, ends = table[out].tolist(), first_of(self.n_a + self.n_b)
        return [b"".join(shown[x:y])[:-1] for x, y in zip(ends[:-1], ends[1:])]


def group_table(size_a: int, size_b: int) -> np.ndarray:
    """Decimal ids with what follows them: of A inside a group and at its end, then the same of B."""
    return np.array([b"%d%s" % (i, s) for n, signs in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for i in range(n) for s in signs], object)


class Aligner:
    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = BytePieces(path_a, pattern), MarkedPieces(path_b)
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.table = group_table(len(self.a.bytes), len(self.b.bytes))

    def block(self, texts: list[str | None]) -> Block:
        """Texts that a tokenization doesn't spell out have no tokens."""
        good = [i for i, t in enumerate(texts) if t and MARK not in t]
        spelt = [" " + texts[i] for i in good]
        packed_a, packed_b = self.a.encode(spelt), self.b.encode([texts[i] for i in good])
        a, b = [b""] * len(texts), [b""] * len(texts)
        for i, t, x, y in zip(good, spelt, packed_a, packed_b):
            data = t.encode()
            if all(b"".join(tokens[np.frombuffer(p, np.int32)].tolist()) == data for tokens, p in ((self.a.bytes, x), (self.b.bytes, y))):
                a[i], b[i] = x, y
        return Block(a, b, self.length_a, self.length_b)


@lru_cache(maxsize=1)
def load(path_a: str, pattern: str, path_b: str) -> Aligner:
    return Aligner(path_a, pattern, path_b)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with at most ``ROWS`` texts and ``CHARS`` characters, or one text."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            part = whole.slice(at, ROWS)
            texts = part.column(2).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                if i > start and size + len(t or "") > CHARS:
                    yield part.slice(start, i - start), texts[start:i]
                    start, size = i, 0
                size += len(t or "")
            yield part.slice(start), texts[start:]


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, pairs, links) of every row; ``row`` numbers rows of this one evaluation.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3``, with ``digest`` its SHA-256 in hex. ``pairs`` are the distinct linked id pairs
    (A's id times ``SHIFT``, and B's id) and ``links`` how often each is linked in the text. A text with very many pairs has
    further rows that hold more pairs and null counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(path_a, pattern, path_b)
        for part, texts in _blocks(batches):
            block = aligner.block(texts)
            shown = block.texts_of_groups(aligner.table, len(aligner.a.bytes))
            shown = [hashlib.sha256(s).hexdigest() if s and digest else s.decode() for s in shown]
            counts = [pa.array(x) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)]
            first = [part.column(0), part.column(1), *counts, pa.array(shown, pa.string())]
            for text, pair, links in block.pairs():
                ends = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pair, links)]
                yield pa.RecordBatch.from_arrays([*first, *lists], names=names)
                first = [*first[:2], *(pa.nulls(part.num_rows, x.type) for x in first[2:])]
            if not len(block.a):
                none = pa.array([[]] * part.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*first, none, none], names=names)

    schema = f"row long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of a table of ``align``: how many rows have the pair linked, and whether no pair of its A id is in more."""
    counts = materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    left = F.shiftright("pair", SHIFT.bit_length() - 1).cast("int")
    most = counts.groupBy(left.alias("a")).agg(F.max("n").alias("most"))
    # One row an entry of A's vocabulary at most.
    joined = counts.withColumn("a", left).join(F.broadcast(most), "a")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, path_a: str, pattern: str, path_b: str, digest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every row: links whose count is the highest of their A id,
    and the sum of counts over links."""
    aligned = materialize(align(docs, path_a, pattern, path_b, digest, id_col, text_col), "aligned")
    counts = materialize(pair_counts(aligned), "counted-pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    counted = join_per_key(each, counts.withColumn("weight", F.col("n")), "pair", "weight", total, hot_share=HOT_SHARE)
    sums = counted.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    own = aligned.where(F.col("n_a").isNotNull()).drop("pairs", "links").join(sums, "row", "left")
    return own.select(id_col, "n_a", "n_b", "n_groups", "n_links", "groups", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
