"""Columns by position, as the algebra addresses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def at(df: DataFrame, index: int) -> Column:
    """The column at ``index``; positions outside the relation are an error."""
    if not 0 <= index < len(df.columns):
        raise IndexError(f"no attribute {index} in a relation of {len(df.columns)}")
    return df[quoted(df.columns[index])]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, first: int = 0) -> DataFrame:
    """The relation with its attributes named ``c0``, ``c1`` and so on."""
    return df.toDF(*(f"c{first + i}" for i in range(len(df.columns))))


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeated names get a number: a, a_1, a_2."""
    used: dict[str, int] = {}
    out = []
    for name in names:
        candidate = name
        while candidate in used:
            candidate = f"{name}_{used[name]}"
            used[name] += 1
        used.setdefault(candidate, 1)
        out.append(candidate)
    return out
