"""Splitting text into the words of byte-level vocabularies, as the library that owns the vocabulary splits it.

Texts of Latin-1 go through a pattern of the standard engine, others through ``regex``. That engine may know a newer Unicode than
a tokenizer's own: characters that the two put into different classes are found one by one, on first sight, and replaced in
a shadow of the text by a character of the right class; the text is then cut where its shadow is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

#: Fixed value: the split pattern of the byte-level files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The same for texts of Latin-1.
LATIN = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_DIGIT}]+| ?[^{_LETTER}{_DIGIT}{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
WIDE = re.compile("[Ā-\U0010ffff]")
#: A character of each class: a letter that is in no contraction, a number, neither.
STAND_IN = {"L": "ā", "N": "٠", "": ""}
_KNOWN = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}")}


def class_by(engine: Callable[[str, str], bool]) -> Callable[[str], str]:
    """The class of a character, L, N or none, by an engine that says whether it matches a pattern."""
    return lambda c: "L" if engine(r"\p{L}", c) else "N" if engine(r"\p{N}", c) else ""


@lru_cache(maxsize=4)
def _tiktoken(pattern: str):
    import tiktoken

    return tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})


def by_tiktoken(pattern: str, c: str) -> bool:
    """Whether tiktoken's engine matches a character: only matches become tokens."""
    return bool(_tiktoken(pattern).encode_ordinary(c))


class Classes:
    """Characters that ``regex`` would put into another class than ``class_of`` does."""

    def __init__(self, class_of: Callable[[str], str]):
        self.class_of, self.seen, self.odd = class_of, set(), {}

    def shadow(self, text: str) -> str:
        """``text`` with a stand-in for each such character; the very same string where there is none."""
        chars = set(text)
        for c in chars - self.seen:
            own = self.class_of(c)
            if own != next((k for k, p in _KNOWN.items() if p.match(c)), ""):
                self.odd[ord(c)] = STAND_IN[own]
            self.seen.add(c)
        return text.translate(self.odd) if self.odd and any(ord(c) in self.odd for c in chars) else text


class Splitter:
    """Splits text by ``PATTERN`` as ``class_of`` sees characters."""

    def __init__(self, pattern: str = PATTERN, class_of: Callable[[str], str] = class_by(by_tiktoken)):
        if pattern != PATTERN:
            raise ValueError("only the split pattern of the byte-level files is supported")
        self.pattern, self.classes = regex.compile(pattern), Classes(class_of)

    def __call__(self, text: str) -> list[str]:
        if not WIDE.search(text):
            return LATIN.findall(text)
        shadow = self.classes.shadow(text)
        if shadow is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]
