"""In-memory relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def tuples(spark: SparkSession, rows: Sequence[tuple], kinds: Sequence[T.DataType]) -> DataFrame:
    """A relation of the given rows, its attributes named ``c0``, ``c1`` and so on, without nulls."""
    schema = T.StructType([T.StructField(f"c{i}", kind, False) for i, kind in enumerate(kinds)])
    return spark.createDataFrame(list(rows), schema)
