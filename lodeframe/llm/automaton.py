"""Tokenization automata, shared by BPE encoding and token counting.

A BPE tokenization is proper exactly when every two neighbouring tokens are: no merge would ever have
crossed the border between them. So the accepted token sequences form the language of a deterministic
automaton with one state per token and an arc ``x -> y`` for every proper pair.

``MergeArcs`` builds those arcs by one gadget per merge, in order. For merge k, ``(u, v) -> w``:

* state ``w`` appears with the arcs into ``u`` and the arcs out of ``v`` as they were just before k;
* the arc ``u -> v`` goes;
* where ``u = v`` the merge is leftmost first, so the arc ``u -> w`` does not appear either.

States share the rows of the states they copy: a gadget is stored as (entry u, exit v, time k) and an arc is
looked up through the entries and exits down to the base alphabet, which is the same relation as the copied
rows without the quadratic table. Looked-up arcs are kept.

``Subsets`` turns the token automaton into a deterministic one over characters: a state is the set of tokens
that may be under way (trie node and the token before it), and because prefixes too have one proper
tokenization, each state knows the last token of the prefix read so far. States are compiled on first use and
the tables are dropped once they pass a bound, also inside a word, so memory stays bounded on any input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

BASE_TIME = -1
START = -1
#: Looked-up arcs kept (about 120 bytes each), and cells of compiled tables (about 100 bytes each; a state has 4, and
#: one more for each token under way and each transition).
MAX_PAIRS, MAX_CELLS = 300_000, 800_000


class MergeArcs:
    """Arcs between tokens, from merges ``(u, v, w)`` of token ids in order of application."""

    def __init__(self, merges: Iterable[tuple[int, int, int]], size: int):
        self.entry, self.exit, self.born = list(range(size)), list(range(size)), [BASE_TIME] * size
        self.gone: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}
        self.merges = 0
        for merge in merges:
            self.add(*merge)

    def add(self, u: int, v: int, w: int) -> None:
        """The gadget of the next merge. What was looked up with ``exists`` before may change; only ``__call__`` keeps answers."""
        k = self.merges
        self.entry[w], self.exit[w], self.born[w] = u, v, k
        self.gone[u, v] = k
        if u == v:
            self.gone[u, w] = k
        self.merges += 1

    def __call__(self, x: int, y: int) -> bool:
        pair = x * len(self.born) + y
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            found = self.known[pair] = self.exists(x, y)
        return found

    def exists(self, x: int, y: int) -> bool:
        """Whether the merges so far leave the arc x -> y."""
        born, gone, before = self.born, self.gone, len(self.born) + 1
        while True:
            if gone.get((x, y), before) < before:
                return False
            bx, by = born[x], born[y]
            if bx == by == BASE_TIME:
                return True
            if bx >= by:
                before, x = bx, self.exit[x]
            if by >= bx:
                before, y = by, self.entry[y]


class Subsets:
    """Deterministic character automaton over the arcs ``joins(x, y)`` between the tokens of ``spelling``.

    ``spelling`` gives each token as a sequence of symbols; every symbol that is fed in must itself be a token.
    A state is a row of transitions: symbol -> (next row, tokens emitted, last token of the prefix read). The
    emitted count is the tokens of the longer prefix less those of the shorter (negative when a merge closes);
    with ``counting`` off it is not kept apart, which needs fewer states.
    """

    def __init__(self, spelling: dict[int, Iterable[str]], joins: Callable[[int, int], bool], counting: bool = False, max_cells: int = MAX_CELLS):
        self.joins, self.counting, self.max_cells = joins, counting, max_cells
        self.child: list[dict[str, int]] = [{}]
        self.token = [START]
        self.length: dict[int, int] = {}
        for t, symbols in spelling.items():
            node = n = 0
            for c in symbols:
                node = self.child[node].setdefault(c, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token.append(START)
                n += 1
            self.token[node] = t
            self.length[t] = n
        self.ids = max(spelling) + 2
        self.reset()

    def reset(self) -> None:
        """Forget all compiled states but the first. A walk goes on from the row it holds."""
        self.cells = 0
        first = (self._pack(0, START, 0),)
        self.first: dict = {None: first}
        self.rows = {first: self.first}

    def _pack(self, node: int, before: int, count: int) -> int:
        return (node * self.ids + before + 1) * 1024 + count + 512

    def compile(self, row: dict, symbol: str) -> tuple[dict, int, int]:
        """Make the transition of a state on ``symbol``; KeyError where no token can hold it."""
        found, emitted, under_way = None, 0, []
        for packed in row[None]:
            rest, count = divmod(packed, 1024)
            node, before = divmod(rest, self.ids)
            node = self.child[node].get(symbol)
            if node is not None:
                t = self.token[node]
                if t != START and (not before or self.joins(before - 1, t)):
                    found, emitted = t, count - 511
                if self.child[node]:
                    under_way.append((node, before - 1, count - 512))
        if found is None:
            raise KeyError(symbol)
        less = emitted if self.counting else 0
        key = (*(self._pack(n, b, c - less) for n, b, c in under_way), self._pack(0, found, 0))
        if self.cells > self.max_cells:
            self.reset()
        to = self.rows.get(key)
        if to is None:
            to = self.rows[key] = {None: key}
            self.cells += 4 + len(key)
        self.cells += 1
        row[symbol] = to, emitted, found
        return row[symbol]

    def count(self, symbols: Iterable[str]) -> int:
        """Number of tokens: the sum of what the transitions emit (needs ``counting``)."""
        row, total = self.first, 0
        for c in symbols:
            try:
                row, emitted, _ = row[c]
            except KeyError:
                row, emitted, _ = self.compile(row, c)
            total += emitted
        return total

    def tokens(self, symbols: Iterable[str]) -> list[int]:
        """The proper tokenization: arcs read backwards from the end of the word."""
        row, ends = self.first, []
        for c in symbols:
            try:
                row, _, last = row[c]
            except KeyError:
                row, _, last = self.compile(row, c)
            ends.append(last)
        out, i = [], len(ends)
        while i:
            out.append(ends[i - 1])
            i -= self.length[out[-1]]
        return out[::-1]
