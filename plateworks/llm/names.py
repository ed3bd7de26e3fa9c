"""Columns of the caller under names of their own, so that no helper column can clash with one of theirs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores before it as it takes to be new, whatever the case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The columns of df as _row0, _row1 and so on, and beside them the columns of more, which are made from those of df.

    They stay separate columns, so that what a caller drops later isn't read or shuffled.
    """
    return df.select(*[F.col(f"`{c}`").alias(f"_row{i}") for i, c in enumerate(df.columns)], *[c.alias(k) for k, c in more.items()])


def restored(columns: Iterable[str]) -> list[tuple[str, Column]]:
    """The columns of packed() under their own names."""
    return [(c, F.col(f"_row{i}").alias(c)) for i, c in enumerate(columns)]


def unpacked(d: DataFrame, columns: Iterable[str], out: str, made: Column) -> DataFrame:
    """The columns of packed() again, without any named as out, and made as out after them."""
    # Made in a select of its own, where no column of the caller can be meant by a name in it.
    columns = list(columns)
    d = d.select(*[f"_row{i}" for i in range(len(columns))], made.alias("_made"))
    return d.select(*[c for name, c in restored(columns) if name.lower() != out.lower()], F.col("_made").alias(out))
