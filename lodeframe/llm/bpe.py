"""BPE encoding and decoding by a tokenization automaton.

The merges of a ``tokenizers`` file are compiled into a deterministic automaton (see ``automaton``); words
split as the file's pre-tokenizer splits them are encoded by its table of transitions and decoded by emitting
the labels of the arcs. Each Python worker compiles the automaton once and keeps a bounded table of short words; tables
are bounded in bytes whatever the texts hold.

Null and empty texts give no tokens. Rows are independent: repeated rows, ties and empty tables need nothing
special, any further input columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from lodeframe.llm.automaton import MergeArcs, Subsets
from lodeframe.llm.splitting import Classes, class_by

#: Words kept per Python worker, their greatest length, and rows turned into one output batch.
MAX_WORDS, LONG, ROWS = 150_000, 60, 256
#: Fixed value: the split pattern of the files that are supported. LATIN_SPLIT is the same for lower-case Latin-1 text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = regex.compile(PATTERN)
LATIN_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿ0-9\s]+")
#: Characters that the Latin-1 pattern, Python's white space or Python's lower case would treat otherwise.
UNUSUAL = re.compile("[\x1c-\x1f\x85ª²³µ¹º¼-¾\u0100-\U0010ffff]")


@lru_cache(maxsize=4)
def _removing(pattern: str) -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(pattern), "removed")


def by_tokenizers(pattern: str, c: str) -> bool:
    """Whether the library's engine matches a character: nothing is left of it."""
    return not _removing(pattern).pre_tokenize_str(c)


class Words(dict):
    """word -> packed ids, filled in by the automaton."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= LONG:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = out
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in visible else free))
        free += b not in visible
    return out


class WordBpe:
    """Encoder and decoder for a lower-casing word-level BPE file with a word-end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        if first["pattern"] != {"Regex": PATTERN} or not first["invert"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only files with this split pattern, NFC and lower case are supported")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        arcs = MergeArcs([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], max(vocab.values()) + 1)
        space = spec["normalizer"]["normalizers"][1]
        # Characters of newer Unicode are what the library takes them for.
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(space["pattern"]["Regex"]), space["content"]), normalizers.Lowercase()])
        self.classes = Classes(class_by(by_tokenizers))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte = byte_symbols()
        self.automaton = Subsets({i: self._symbols(t) for t, i in vocab.items()}, arcs)
        self.words = Words(self.word)

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def word(self, word: str) -> bytes:
        """Ids of one pre-split word, as packed 32-bit integers."""
        shown = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
        if not shown.isprintable():
            shown = "".join(map(self.byte.__getitem__, word.encode()))
        symbols = [*shown[:-1], shown[-1] + self.end]
        return array("i", self.automaton.tokens(symbols)).tobytes()

    def split(self, text: str) -> list[str]:
        """Normalise (NFC, lower case) and split into words; white space goes."""
        if UNUSUAL.search(text):
            shown = self.normalizer.normalize_str(text)
            shadow = self.classes.shadow(shown)
            return SPLIT.findall(shown) if shadow is shown else [shown[m.start() : m.end()] for m in SPLIT.finditer(shadow)]
        return LATIN_SPLIT.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a whole text; strings of special tokens inside it are those tokens."""
        words, out = self.words, []
        for k, part in enumerate(self.special_re.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out.append(b"".join(map(words.__getitem__, self.split(part))))
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def labels(path: str) -> np.ndarray:
    """Arc labels by id, those of special tokens included; ids that the file leaves out are empty."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    label = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return np.array([label.get(i, "") for i in range(max(label) + 1)], object)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text. ``vocabulary`` is the file's path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                packed = [bpe.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype="i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) for rows of ids: arc labels, joined as a file without a decoder joins them; null ids decode to
    the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = labels(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                ids = part.column(1)
                flat = table[ids.flatten().to_numpy(zero_copy_only=False)].tolist()
                ends = np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(ids).to_pylist())])
                texts = [" ".join(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], names=[id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")
