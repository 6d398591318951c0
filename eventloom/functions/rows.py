"""Whole rows as one column, so that an operator's own columns can't clash with a caller's, whatever those are named."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{column.replace('`', '``')}`")


def packed(df: DataFrame, name: str = "row") -> Column:
    return F.struct(*[named(c) for c in df.columns]).alias(name)


def unpacked(columns: Iterable[str], name: str = "row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]
