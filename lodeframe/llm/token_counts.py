"""Token counts by a compiled finite-state tokenizer.

A sentencepiece BPE model is compiled into a deterministic transducer over characters (``automaton.Subsets``):
each transition carries the number of tokens it emits, so counting is a walk through the table. No piece holds
a character before the word mark U+2581, or Latin letters beside other characters, so the transducer is back in its
start state at such places (resets) and the stretch between two of them (a unit) always adds the same count; a
bounded table keeps it.

A long text is read in chunks cut at any character. The state at a cut is the token that holds the character before
it, and where that token ends. What a chunk does is a map from each state that its cut allows (the pieces found there in the
text, at most the square of the longest piece) to the state at its end and a count: the transducer is run from all
states at once, and runs that reach the same token at the same place go on as one. A proper tokenization is unique, so
each pair of states has one count at most. Between resets the compiled table does the work. Maps compose
associatively, so ``scan`` combines them by a parallel prefix (each round joins neighbours at doubled distance); the map
of the whole text has the one count. The chunks of a text are read by its task.

Null and empty texts have zero tokens; repeated rows, null ids, ties and empty tables need nothing special.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeframe.llm.automaton import MAX_PAIRS, START, Subsets

#: Units kept per Python worker, characters of a chunk, length beyond which units are not kept, rows read at once.
MAX_UNITS, CHUNK, LONG, ROWS = 200_000, 1 << 18, 60, 256
#: The state after a character without a piece, and at the start of a text: any token may follow.
FREE = START
MARK = "▁"
#: A unit: Latin letters, or other characters, with the marks in front of them.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
UNIT = re.compile(f"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}]+)|{MARK}+")
LETTER = re.compile(f"[{LATIN}]")
#: The last character before a mark that follows something else.
RESET = re.compile(f"[^{MARK}]{MARK}")


class Units(dict):
    """unit -> tokens, filled in by the transducer."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, unit: str) -> int:
        out = self.make(unit)
        if len(unit) <= LONG:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[unit] = out
        return out


#: (token, characters of it after the cut) -> the same at the next cut -> tokens emitted.
State = tuple[int, int]
Map = dict[State, dict[State, int]]


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model with byte fallback emits."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(p.type == 4 for p in model.pieces) or any(MARK in p.lstrip(MARK) for _, p, _ in normal):
            raise ValueError("user-defined pieces, and pieces with a mark inside, are not supported")
        if any((LETTER.match(a) is None) != (LETTER.match(b) is None) for _, p, _ in normal for a, b in zip(p, p[1:]) if a != MARK):
            raise ValueError("pieces that join Latin letters and other characters are not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p: s for _, p, s in normal}
        self.text = {i: p for i, p, _ in normal}
        self.single = {p for _, p, _ in normal if len(p) == 1}
        self.unknown = re.compile("[^" + re.escape("".join(sorted(self.single))) + "]")
        if not {c for _, p, _ in normal for c in p} <= self.single:
            raise ValueError("every character of a piece must be a piece")
        self.known: dict[int, bool] = {}
        self.longest = max(len(p) for _, p, _ in normal)
        self.transducer = Subsets({i: p for i, p, _ in normal}, self._joins, counting=True)
        self.units = Units(self.unit)

    def _joins(self, x: int, y: int) -> bool:
        """Whether x, y is a proper pair: merging their text anew, best score and then leftmost first, gives them back."""
        pair = x << 32 | y
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            a, b, score = self.text[x], self.text[y], self.score
            parts = [*a, *b]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.known[pair] = parts == [a, b]
        return found

    def unit(self, text: str) -> int:
        """Tokens of a stretch between resets. A character without a piece resets the transducer and emits its bytes."""
        if not self.unknown.search(text):
            return self.transducer.count(text)
        known = sum(self.transducer.count(part) for part in self.unknown.split(text) if part)
        return known + sum(len(c.encode()) for c in self.unknown.findall(text))

    def marked(self, text: str) -> int:
        """Tokens of marked text that begins and ends at a reset."""
        return sum(map(self.units.__getitem__, UNIT.findall(text)))

    def pieces_from(self, text: str, i: int) -> Iterator[tuple[int, int]]:
        """(token, end) of the pieces that begin at i; a character without a piece ends in the state FREE."""
        child, token, node = self.transducer.child, self.transducer.token, 0
        if text[i] not in self.single:
            yield FREE, i + 1
            return
        for j in range(i, min(len(text), i + self.longest)):
            node = child[node].get(text[j])
            if node is None:
                return
            if token[node] != START:
                yield token[node], j + 1

    def states(self, text: str, cut: int) -> list[State]:
        """All states that ``cut`` allows."""
        if not cut:
            return [(FREE, 0)]
        begin = range(max(0, cut - self.longest), cut)
        return [(t, end - cut) for i in begin for t, end in self.pieces_from(text, i) if end >= cut]

    def run(self, text: str, entries: dict[State, dict], start: int, stop: int) -> dict[State, dict]:
        """The origins, with counts, that reach each state at ``stop`` from the states ``entries`` at ``start``."""
        at: dict[int, dict[int, tuple[dict, int]]] = {}
        out: dict[State, tuple[dict, int]] = {}

        def arrive(token: int, end: int, origins: dict, more: int) -> None:
            place, key = (out, (token, end - stop)) if end >= stop else (at.setdefault(end, {}), token)
            if key in place:
                before, less = place[key]
                origins, more = {k: n + less for k, n in before.items()} | {k: n + more for k, n in origins.items()}, 0
            place[key] = origins, more

        for (token, rest), origins in entries.items():
            arrive(token, start + rest, origins, 0)
        for i in range(start, stop):
            here = at.pop(i, None)
            if here:
                for token, end in self.pieces_from(text, i):
                    emitted = 1 if token != FREE else len(text[i].encode())
                    for before, (origins, n) in here.items():
                        if FREE in (before, token) or self._joins(before, token):
                            arrive(token, end, origins, n + emitted)
        return {s: {k: n + more for k, n in origins.items()} for s, (origins, more) in out.items()}

    def chunk(self, text: str, start: int, stop: int) -> Map:
        """The map of text[start:stop], a stretch of marked text. At a reset every state is as good as FREE."""
        entries: dict[State, dict] = {s: {s: 0} for s in self.states(text, start)}
        first = RESET.search(text, start, stop)
        if first:
            at, last = first.start() + 1, stop - 1
            while not (text[last] == MARK and text[last - 1] != MARK):
                last -= 1
            reached: dict = {}
            for origins in self.run(text[:at], entries, start, at).values():
                reached |= {k: n + self.marked(text[at:last]) for k, n in origins.items()}
            entries, start = {(FREE, 0): reached}, last
        out: Map = {}
        for exit, origins in self.run(text, entries, start, stop).items():
            for entry, n in origins.items():
                out.setdefault(entry, {})[exit] = n
        return out

    @staticmethod
    def compose(a: Map, b: Map) -> Map:
        """The map of chunk a followed by chunk b."""
        return {s: {e: n + m for via, n in exits.items() for e, m in b.get(via, {}).items()} for s, exits in a.items()}

    def scan(self, maps: list[Map]) -> list[Map]:
        """Inclusive prefix scan in log2(n) rounds of independent compositions."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = self.prefix + text.replace(" ", MARK)
        if len(text) <= chunk:
            return self.marked(text)
        # A chunk sees the pieces that cross its cuts, and nothing beyond.
        reach, maps = self.longest, []
        for at in range(0, len(text), chunk):
            low, high = max(0, at - reach), min(len(text), at + chunk + reach)
            maps.append(self.chunk(text[low:high], at - low, min(len(text), at + chunk) - low))
        return self.scan(maps)[-1][FREE, 0].popitem()[1]


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text. ``model`` is the file's path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model)
        for whole in batches:
            counts = [counter.count(t) if t else 0 for at in range(0, whole.num_rows, ROWS) for t in whole.column(1).slice(at, ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(2), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_col, text.alias(text_col), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
