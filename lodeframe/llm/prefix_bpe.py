"""Byte-level BPE by prefix dynamic programming: the last token of every byte prefix.

A tokenization is proper when each two neighbouring tokens are (``automaton.MergeArcs``), every prefix of a word has
exactly one proper tokenization, and a prefix of that is proper too. So one number a byte tells all: the last token of the
prefix that ends there. It is the one token t that ends there and goes with the last token of the prefix before t; tokens that
end at a byte are found by a walk through the reversed vocabulary. Reading the numbers backwards gives the tokens.

What comes later never changes a prefix, so text can be appended exactly. After an edit the numbers are computed anew
only until as many of them as the longest token has bytes agree with the old ones; from there on all do. Matches of
the split pattern, which never looks back, are found anew until one ends where an old one did.

Merges follow from the ranks: a token comes from the only split into two earlier tokens that are proper neighbours at its
rank. Words that are an entry are that token, as in the library. Each Python worker compiles the tables once, and keeps
a bounded table of short words.

Null and empty texts have no tokens. Rows are independent: repeated rows, null ids, ties and empty tables need nothing
special; further columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from lodeframe.llm.automaton import MAX_PAIRS, MergeArcs
from lodeframe.llm.splitting import Splitter

#: Words kept per Python worker (about 200 bytes each), their greatest length in characters, rows turned into one output batch.
MAX_WORDS, LONG, ROWS = 300_000, 60, 256
#: Bytes of the prefixes that are kept for the words that begin with them, and how many of them (about 200 bytes each).
HEAD, MAX_HEADS = 5, 100_000
#: A match of the split pattern depends on no more characters than these after its end.
AHEAD = 3
NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a ``tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Prefixes:
    """Tables of a vocabulary of ranks, and the dynamic program over the prefixes of a word."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.arcs = MergeArcs((), self.size)
        usable = {t: r for t, r in ranks.items() if len(t) == 1}
        if len(usable) < 256:
            raise ValueError("every byte must have a rank")
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                u, v = usable.get(token[:cut]), usable.get(token[cut:])
                if u is not None and v is not None and self.arcs.exists(u, v):
                    self.arcs.add(u, v, rank)
                    usable[token] = rank
                    break
        #: Prefixes of HEAD bytes that words share.
        self.heads: dict[bytes, list[int]] = {}
        #: Reversed trie in one table: node * 256 + byte -> node, and the token that a node spells.
        self.step: dict[int, int] = {}
        self.token = [NONE]
        self.length = {r: len(t) for t, r in usable.items()}
        self.longest = max(self.length.values())
        for token, rank in usable.items():
            node = 0
            for b in reversed(token):
                node = self.step.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(NONE)
            self.token[node] = rank

    def extend(self, data: bytes, ends: list[int], stop: int | None = None) -> list[int]:
        """``ends`` of a prefix of ``data`` brought up to its first ``stop`` bytes (all), in place: an exact append."""
        get, token, arcs, known, size = self.step.get, self.token, self.arcs, self.arcs.known.get, self.size
        for end in range(len(ends), len(data) if stop is None else stop):
            node, i = 0, end
            while (node := get(node << 8 | data[i])) is not None:
                t = token[node]
                if t >= 0:
                    if not i:
                        break
                    before = ends[i - 1]
                    joins = known(before * size + t)
                    if joins or joins is None and arcs(before, t):
                        break
                i -= 1
                if i < 0:
                    raise ValueError("no proper tokenization")
            else:
                raise ValueError("no proper tokenization")
            ends.append(t)
        return ends

    def edit(self, data: bytes, ends: list[int], fresh: int, kept: list[int]) -> int:
        """Like ``extend``, where the prefixes of ``data`` beyond ``fresh`` bytes were ``kept`` (the old numbers of what is now
        the tail of ``data``) before an edit in front of them. Returns how many prefixes were computed."""
        began, same, shift = len(ends), 0, len(data) - len(kept)
        for end in range(began, len(data)):
            self.extend(data, ends, end + 1)
            same = same + 1 if end >= max(fresh, shift) and kept[end - shift] == ends[end] else 0
            if same >= self.longest:
                ends += kept[end + 1 - shift :]
                return end + 1 - began
        return len(data) - began

    def read(self, ends: list[int]) -> list[int]:
        """The tokens, read backwards from the last one."""
        out, i = [], len(ends)
        while i:
            out.append(ends[i - 1])
            i -= self.length[out[-1]]
        return out[::-1]

    def tokens(self, data: bytes) -> list[int]:
        """Tokens of one word."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        head = data[:HEAD]
        ends = self.heads.get(head)
        if ends is None:
            if len(self.heads) >= MAX_HEADS:
                self.heads.clear()
            ends = self.heads[head] = self.extend(head, [])
        return self.read(self.extend(data, ends.copy()))


class Words(dict):
    """word -> packed ids, filled in by ``make``; a bounded number of short words stays."""

    def __init__(self, make: Callable[[str], bytes], most: int = MAX_WORDS):
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


class ByteEncoder:
    """Ids of whole texts; strings of special tokens are text like any other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, split: Splitter | None = None):
        self.prefixes, self.split = Prefixes(ranks), split or Splitter(pattern)
        self.words = Words(lambda word: array("i", self.prefixes.tokens(word.encode())).tobytes())

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids."""
        return b"".join(map(self.words.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> np.ndarray:
    """Byte strings by id; ids that the file leaves out are empty."""
    ranks = read_ranks(path)
    out = np.full(max(ranks.values()) + 1, b"", object)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def byte_bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text. ``ranks`` is the file's path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                packed = [encoder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype="i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, ids array<int>")


def byte_bpe_decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) for rows of ids: their bytes, which need not be whole characters. Null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                ids = part.column(1)
                flat = table[ids.flatten().to_numpy(zero_copy_only=False)].tolist()
                ends = np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(ids).to_pylist())])
                decoded = pa.array([b"".join(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=[id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {_kind(encoded, id_col)}, `{ids_col}` array<int>, decoded binary")


class Stored:
    """A text with the ends of its matches (code points) and the last token of each byte prefix within its match."""

    def __init__(self, encoder: ByteEncoder, text: str, cuts: list[int], last: list[int]):
        self.encoder, self.text, self.cuts, self.last = encoder, text, cuts, last

    @classmethod
    def of(cls, encoder: ByteEncoder, text: str) -> Stored:
        out = cls(encoder, "", [], [])
        out.edit(0, 0, text)
        return out

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop] by ``new``; equal start and stop insert, at the end append. Returns how many
        prefixes were computed."""
        old, cuts, prefixes = self.text, self.cuts, self.encoder.prefixes
        text = old[:start] + new + old[stop:]
        keep = bisect_right(cuts, start - AHEAD)
        begin = cuts[keep - 1] if keep else 0
        shift, done, ends, again = len(text) - len(old), begin, [], len(cuts)
        pieces: list[str] = []
        for word in self._words(text, begin):
            pieces.append(word)
            done += len(word)
            ends.append(done)
            if done >= start + len(new):
                i = bisect_left(cuts, done - shift)
                if i < len(cuts) and cuts[i] == done - shift:
                    again = i + 1
                    break
        low = len(old[:begin].encode())
        high = low + len(old[begin : cuts[again - 1] if cuts else 0].encode()) if again > keep else low
        computed, last, at = 0, [], begin
        for word in pieces:
            data, own = word.encode(), []
            fresh, kept = len(data), []
            first = cuts[keep] if keep < len(cuts) else len(old)
            if at == begin and start > begin:
                # The match that the edit reaches into keeps the prefixes before it.
                own = self.last[low : low + len(old[begin : min(start, first, begin + len(word))].encode())]
            i = bisect_left(cuts, at + len(word) - shift)
            if at <= start + len(new) <= at + len(word) and i < len(cuts) and cuts[i] == at + len(word) - shift:
                # It also ends as an old one did, whose prefixes may be reached again.
                tail = max(stop, cuts[i - 1] if i else 0)
                before = len(old[cuts[i - 1] if i else 0 : tail].encode())
                base = high - len(old[cuts[i - 1] if i else 0 : cuts[i]].encode())
                kept = self.last[base + before : high]
                fresh = len(data) - len(kept)
            computed += prefixes.edit(data, own, fresh, kept)
            last += own
            at += len(word)
        self.text, self.cuts = text, cuts[:keep] + ends + [c + shift for c in cuts[again:]]
        self.last = self.last[:low] + last + self.last[high:]
        return computed

    def _words(self, text: str, begin: int) -> Iterator[str]:
        """Matches from ``begin`` on, in stretches of doubled length: a stretch's last matches may be cut short by its end."""
        size, whole = 256, len(text)
        while begin < whole:
            stretch = text[begin : begin + size]
            words = self.encoder.split(stretch)
            if begin + size < whole:
                total = len(stretch)
                while words and total + AHEAD > len(stretch):
                    total -= len(words.pop())
            size *= 2
            for w in words:
                yield w
                begin += len(w)

    def tokens(self) -> list[int]:
        out, at, p = [], 0, 0
        for cut in self.cuts:
            data = self.text[at:cut].encode()
            whole = self.encoder.prefixes.ranks.get(data)
            out += self.encoder.prefixes.read(self.last[p : p + len(data)]) if whole is None else [whole]
            at, p = cut, p + len(data)
        return out


def _stored(rows: list[Stored], first: list[pa.Array], names: list[str], computed: list[int]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    own = [pa.array([r.text for r in rows], pa.string()), pa.array([r.cuts for r in rows], ints), pa.array([r.last for r in rows], ints), pa.array([r.tokens() for r in rows], ints), pa.array(computed, pa.int64())]
    return pa.RecordBatch.from_arrays([*first, *own], names=names)


def byte_bpe_prefixes(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, cuts, last, ids, computed) of every whole text, to be kept for appends and edits: where matches end, the last
    token of each byte prefix, the ids, and how many prefixes were computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                rows = [Stored.of(encoder, t or "") for t in part.column(1).to_pylist()]
                yield _stored(rows, [part.column(0)], [id_col, "text", "cuts", "last", "ids", "computed"], [len(r.last) for r in rows])

    schema = f"`{id_col}` {_kind(docs, id_col)}, text string, cuts array<int>, last array<int>, ids array<int>, computed long"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def byte_bpe_edit(stored: DataFrame, ranks: str, pattern: str, start: str = "start", stop: str = "stop", new: str = "new", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``byte_bpe_prefixes`` with columns ``start``, ``stop`` (code points, clipped to the text) and ``new`` added become the rows of
    the edited text. A null start appends, a null stop replaces nothing, a null ``new`` deletes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                rows, computed = [], []
                for text, cuts, last, a, b, put in zip(*(part.column(i).to_pylist() for i in range(1, 7))):
                    row = Stored(encoder, text or "", cuts or [], last or [])
                    a = len(row.text) if a is None else max(0, min(a, len(row.text)))
                    computed.append(row.edit(a, a if b is None else max(a, min(b, len(row.text))), put or ""))
                    rows.append(row)
                yield _stored(rows, [part.column(0)], [id_col, "text", "cuts", "last", "ids", "computed"], computed)

    schema = f"`{id_col}` {_kind(stored, id_col)}, text string, cuts array<int>, last array<int>, ids array<int>, computed long"
    rows = stored.select(id_col, "text", "cuts", "last", F.col(start).cast("int"), F.col(stop).cast("int"), F.col(new).cast("string"))
    return rows.mapInArrow(run, schema)
