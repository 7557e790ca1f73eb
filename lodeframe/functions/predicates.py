"""Column predicates and scalar functions over names, paths, modifiers and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Access bits of the JVM class-file format.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL = 0x1, 0x2, 0x4, 0x8, 0x10
BRIDGE, VARARGS, TRANSIENT, INTERFACE, ABSTRACT = 0x40, 0x80, 0x80, 0x200, 0x400
SYNTHETIC, ANNOTATION, ENUM = 0x1000, 0x2000, 0x4000
#: How a comment line begins once it is trimmed.
COMMENT_STARTS = ("//", "/*", "* ", "*\t", "*/")
CONTROLS = "".join(map(chr, range(33)))
#: Descriptor letters of the primitive types.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def has_bits(modifiers: Column, mask: int) -> Column:
    """True if any bit of ``mask`` is set."""
    return modifiers.bitwiseAND(F.lit(mask)) != 0


def is_standard(modifiers: Column) -> Column:
    """Neither interface nor annotation nor enum."""
    return ~has_bits(modifiers, INTERFACE | ANNOTATION | ENUM)


def is_package_visible(modifiers: Column) -> Column:
    return ~has_bits(modifiers, PUBLIC | PRIVATE | PROTECTED)


def _glob(glob: str, star: str, double: str, one: str) -> str:
    return "".join(double if p == "**" else star if p == "*" else one if p == "?" else re.escape(p) for p in re.findall(r"\*\*|.", glob, re.S))


def simple_glob(column: Column, glob: str) -> Column:
    """Whole-value match where ``*`` is anything and nothing else is special."""
    return column.rlike("^(?s:" + ".*".join(re.escape(p) for p in glob.split("*")) + r")\z")


def path_glob(column: Column, glob: str) -> Column:
    """Whole-path match: ``*`` stays inside a segment, ``**`` crosses segments, ``?`` is one character."""
    return column.rlike("^(?s:" + _glob(glob, "[^/]*", ".*", ".") + r")\z")


def contains_glob(column: Column, glob: str) -> Column:
    r"""Unanchored, in either case; ``*`` crosses ``/``; a backslash in the glob is a ``/``."""
    return column.rlike("(?is)" + _glob(glob.replace("\\", "/").replace("**", "*"), ".*", ".*", "."))


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def accepted(column: Column, accept: list[str], reject: list[str], match=path_glob) -> Column:
    """An empty accept list takes everything; a reject always wins."""
    taken = any_of([match(column, g) for g in accept]) if accept else F.lit(True)
    return taken & ~any_of([match(column, g) for g in reject])


def in_package(column: Column, package: str, recursive: bool = True, separator: str = ".") -> Column:
    """Names in a package, or with ``recursive`` also below it."""
    same = package_of(column, separator) == package
    return same | column.startswith(package + separator) if recursive else same


def java_trim(text: Column) -> Column:
    """Without the characters up to U+0020 at both ends."""
    return F.btrim(text, F.lit(CONTROLS))


def is_pattern(query: str) -> bool:
    """Whether the JVM, which will run it, takes the regular expression."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(query)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def line_match(line: Column, query: str, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> Column:
    """Regex find, else whole word, else substring; a blank query or an invalid pattern matches nothing.

    A regular expression ignores the case of ASCII letters only; otherwise both sides are lower-cased. A word ends where
    no Java identifier goes on, so ``$`` and letters of any script belong to words.
    """
    if not query or query.isspace():
        return F.lit(False)
    if regex:
        return line.rlike(("" if case_sensitive else "(?i)") + query) if is_pattern(query) else F.lit(False)
    content, wanted = (line, query) if case_sensitive else (F.lower(line), query.lower())
    if whole_word:
        quoted = "\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return content.rlike(r"(?<!\p{javaJavaIdentifierPart})" + quoted + r"(?!\p{javaJavaIdentifierPart})")
    return content.contains(wanted)


def is_comment_line(line: Column, starts: tuple[str, ...] = COMMENT_STARTS) -> Column:
    body = java_trim(line)
    return any_of([body.startswith(s) for s in starts]) | (body == "*")


def package_of(name: Column, separator: str = "/") -> Column:
    """What stands before the last separator; empty where that is missing or first."""
    at = F.length(name) - F.length(F.substring_index(name, separator, -1)) - len(separator)
    return F.when(at > 0, F.substring(name, F.lit(1), at)).otherwise(F.lit(""))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the leaf name, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(leaf(path), r"\.([^.]*)$", 1))


def simple_name(name: Column) -> Column:
    """A class name without package and outer classes."""
    return F.regexp_extract(name, r"([^/.$]*)$", 1)


def modifier_text(modifiers: Column) -> Column:
    """Keywords of the usual order, space-joined."""
    words = {PUBLIC: "public", PRIVATE: "private", PROTECTED: "protected", STATIC: "static", FINAL: "final", ABSTRACT: "abstract"}
    return F.concat_ws(" ", *(F.when(has_bits(modifiers, bit), F.lit(word)) for bit, word in words.items()))


def parameter_types(descriptor: Column) -> Column:
    """Array of the parameter type descriptors of a method descriptor."""
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\((.*)\)", 1), F.lit(r"\[*(?:[BCDFIJSZ]|L[^;]*;)"), F.lit(0))


def type_name(descriptor: Column) -> Column:
    """Source form of a type descriptor: ``[Ljava/lang/String;`` is ``java.lang.String[]``."""
    core = F.regexp_replace(descriptor, r"^\[+", "")
    named = F.translate(F.regexp_extract(core, "^L([^;]*);$", 1), "/", ".")
    for letter, word in PRIMITIVES.items():
        named = F.when(core == letter, F.lit(word)).otherwise(named)
    return F.concat(named, F.repeat(F.lit("[]"), F.length(descriptor) - F.length(core)))
