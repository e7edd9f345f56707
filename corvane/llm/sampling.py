"""Bounded, reproducible samples of labelled rows, and how rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_ids(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``labelled`` (with doc_id), the first by a hash of the id.

    Only hashes below a threshold are sorted; it follows from the number of
    rows, so that about twice the limit are left, whatever the table's size.
    """
    order = F.xxhash64("doc_id", F.lit("sample"))
    n = labelled.count()
    if n > 2 * limit:
        few = labelled.filter(F.shiftrightunsigned(order, 1) < min(2**63 - 1, (2 * limit + 1000) * 2**63 // n))
        if few.count() >= limit:  # but for tables where many rows share few ids
            labelled = few
    return labelled.orderBy(order, "doc_id").limit(limit)
