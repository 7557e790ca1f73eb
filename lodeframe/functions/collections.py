"""Columns over arrays and maps that Spark has no single function for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def merge_maps(first: Column, second: Column) -> Column:
    """Entries of both maps; the second wins where both have a key, whatever the session's policy on duplicate keys."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def drop_empty(multimap: Column) -> Column:
    """A map of arrays without its empty and null entries."""
    return F.map_filter(multimap, lambda k, v: F.coalesce(F.size(v) > 0, F.lit(False)))


def same_elements(first: Column, second: Column) -> Column:
    """Equal size, and the first holds all of the second. This isn't equality of multisets: [1, 1, 2] and [1, 2, 2] are the same."""
    return (F.size(first) == F.size(second)) & (F.size(F.array_except(second, first)) == 0)


def single(array: Column, accept) -> Column:
    """The only element that ``accept`` takes; null where none or several are taken."""
    found = F.filter(array, accept)
    return F.when(F.size(found) == 1, F.get(found, 0))


def none_match(array: Column, accept) -> Column:
    """True where ``accept`` takes no element; an empty array has none."""
    return ~F.exists(array, accept)
