"""Columns over class, package and member names and descriptors: paths, validity, counts of parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words of the language that name nothing.
RESERVED = (
    "_", "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue",
    "default", "do", "double", "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto", "if",
    "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package", "private",
    "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "true", "try", "void", "volatile", "while",
)
#: Short names that are in common use.
SHORT_WORDS = (
    "id", "db", "ui", "io", "ok", "no", "tag", "key", "val", "url", "uri", "sql", "xml", "api", "dto", "dao", "vo",
    "bo", "po", "to", "ctx", "cfg", "src", "dst", "min", "max", "len", "idx", "tmp", "buf", "msg", "req", "res",
    "err", "log", "map", "set", "num",
)


def normalize_path(path: Column) -> Column:
    """Without slashes at both ends."""
    return F.btrim(path, F.lit("/"))


def path_to_package(path: Column) -> Column:
    return F.translate(path, "/", ".")


def package_to_path(package: Column) -> Column:
    return F.translate(package, ".", "/")


def class_file_path(name: Column) -> Column:
    """Path of the file of a dotted class name."""
    return F.concat(package_to_path(name), F.lit(".class"))


def java_version(major: Column) -> Column:
    """Version of the language for a class-file major version; numbers below the first one stay."""
    return F.when(major >= 45, major - 44).otherwise(major)


def is_obfuscated(name: Column) -> Column:
    """One to three letters, digits, ``_`` or ``$`` (no surrogates), and no short word in common use; null and empty are not."""
    short = name.rlike(r"^[\p{L}\p{Nd}_$&&[\x00-￿]]{1,3}\z") & ~F.lower(name).isin(*SHORT_WORDS)
    return F.coalesce(short, F.lit(False))


def is_valid_name(name: Column) -> Column:
    """An identifier of Java, letters of any script included, that is no reserved word; null and empty are not."""
    good = name.rlike(r"^\p{javaJavaIdentifierStart}\p{javaJavaIdentifierPart}*\z") & ~name.isin(*RESERVED)
    return F.coalesce(good, F.lit(False))


def is_printable_ascii(name: Column) -> Column:
    """All of U+0020 to U+007E, and not blank; null is not."""
    return F.coalesce(name.rlike(r"^[\x20-\x7E]+\z") & (F.btrim(name) != ""), F.lit(False))


def is_poor_name(name: Column) -> Column:
    """Names that a rename is due for: obfuscated, invalid or not printable."""
    return is_obfuscated(name) | ~is_valid_name(name) | ~is_printable_ascii(name)


def return_type(descriptor: Column) -> Column:
    """What stands after the first ``)``, a class by its name alone; ``V`` for a blank descriptor, or where nothing does."""
    found = F.regexp_extract(F.coalesce(descriptor, F.lit("")), r"^[^)]*\)((?s:.+))\z", 1)
    return F.when(found == "", "V").otherwise(F.regexp_replace(found, r"^L([^;]*);\z", "$1"))


def parameter_count(descriptor: Column) -> Column:
    """Number of parameters of a method descriptor; -1 for null, or without parentheses, or with an unended class name."""
    inner = F.regexp_extract(descriptor, r"^[^(]*\(([^)]*)\)", 1)
    count = F.size(F.regexp_extract_all(inner, F.lit(r"\[*(?:L[^;]*;|[^L\[])|\[+$"), F.lit(0)))
    bad = descriptor.isNull() | ~descriptor.rlike(r"^[^(]*\([^)]*\)") | inner.rlike(r"^(?:\[*(?:L[^;]*;|[^L\[]))*\[*L[^;]*\z")
    return F.when(bad, -1).otherwise(count)


def has_parameter_count(descriptor: Column, count: int) -> Column:
    """Whether a descriptor has ``count`` parameters: none without a ``(`` at its start; false for letters of no type."""
    inner = F.regexp_extract(F.coalesce(descriptor, F.lit("")), r"^\(([^)]*)\)", 1)
    one = r"(?:\[+(?:L[^;]*;|[^L]|\z)|[BCDFIJSZ]|L[^;]*;)"
    return inner.rlike("^" + one * count + r"\z") if count else inner == ""
