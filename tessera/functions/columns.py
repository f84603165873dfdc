"""Small builders over columns: substring tests against ordered term lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: as a lambda variable its expression isn't copied to where it is used."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _listed(terms: Iterable[str]) -> Column:
    return F.array(*map(F.lit, terms))


def contains_any(value: Column, terms: Iterable[str]) -> Column:
    """Whether any term is a substring. A loop over a constant list: unrolled tests of the long lists outgrow what the
    JVM compiles."""
    return bound(value, lambda v: F.exists(_listed(terms), lambda t: v.contains(t)))


def ends_with_any(value: Column, terms: Iterable[str]) -> Column:
    return bound(value, lambda v: F.exists(_listed(terms), lambda t: v.endswith(t)))


def count_contained(value: Column, terms: Iterable[str]) -> Column:
    """How many of the terms are substrings."""
    return bound(value, lambda v: F.size(F.filter(_listed(terms), lambda t: v.contains(t))))


def contained(value: Column, terms: Iterable[str], prefix: str = "") -> Column:
    """The terms that are substrings, in the order of the list."""
    found = bound(value, lambda v: F.filter(_listed(terms), lambda t: v.contains(t)))
    return F.transform(found, lambda t: F.concat(F.lit(prefix), t)) if prefix else found


def joined(*values: Column) -> Column:
    """Non-empty values with a blank between them, in lower case."""
    parts = F.filter(F.array(*(F.coalesce(v, F.lit("")) for v in values)), lambda v: v != "")
    return F.lower(F.array_join(parts, " "))


def nullif_empty(value: Column) -> Column:
    return F.when(value != "", value)
