"""Keyed tables: point lookups, upserts and erasure over immutable files.

A keyed table is a DataFrame with one row a key.  Changes give a new
DataFrame; write it to a new folder.  Sort by key before writing (``clustered``)
so that row-group statistics prune point lookups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clustered(table: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The table dealt by key ranges and sorted, for writing."""
    dealt = table.repartitionByRange(partitions, key) if partitions else table.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none; the filter reaches the scan."""
    return table.filter(F.col(key) == F.lit(value))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Inserts keys and overwrites those that exist; of several changes the last by ``order`` wins.

    One shuffle by key: old rows are ordered before all changes, and the
    largest is taken by an aggregation with map-side combining.
    """
    columns = table.columns
    old = table.select(*columns, F.lit(0).alias("_new"), F.lit(None).cast(changes.schema[order].dataType).alias("_order"))
    new = changes.select(*columns, F.lit(1).alias("_new"), F.col(order).alias("_order"))
    rest = [c for c in columns if c != key]
    latest = F.max_by(F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none")), F.struct("_new", "_order"))
    merged = old.unionByName(new).groupBy(key).agg(latest.alias("_row"))
    return merged.select(*(F.col(c) if c == key else F.col("_row")[c].alias(c) for c in columns))


def erase(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the given keys; keys that it lacks are ignored."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def erase_values(table: DataFrame, key: str, values: Iterable) -> DataFrame:
    return table.filter(~F.col(key).isin(list(values)))
