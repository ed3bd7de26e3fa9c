"""Predicates, severities and status columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent_ratio(extent: Column, largest: Column) -> Column:
    """extent / largest; infinite where that is not finite or zero."""
    bad = largest.isNull() | (largest == 0) | F.isnan(largest) | (F.abs(largest) == float("inf"))
    return F.when(bad, F.lit(float("inf"))).otherwise(extent / largest)


def severity(ratio: Column, in_domain: Column, warn: float, fail: float) -> Column:
    """pass, warning or quarantine; a breach of the domain is always quarantined."""
    return F.when(~in_domain | (ratio > fail), "quarantine").when(ratio <= warn, "pass").otherwise("warning")


def reasons(tests: Mapping[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda x: x.isNotNull())


def first_of(tests: Mapping[str, Column], default: str) -> Column:
    """The name of the first test that holds."""
    out = None
    for name, c in tests.items():
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.lit(default) if out is None else out.otherwise(default)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether the lower-cased text holds a needle; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def alias(*cols: Column) -> Column:
    """The first name of a field that is set, then its older names, then its default."""
    return F.coalesce(*cols)
