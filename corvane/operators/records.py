"""Records of bytes under stable addresses: a keyed table ``(tid, payload)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import bits
from corvane.operators import keyed


def read(records: DataFrame, tid: int) -> DataFrame:
    return keyed.lookup(records, "tid", tid)


def write(records: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Overwrites payloads by address; addresses that don't exist are ignored."""
    known = changes.join(records.select("tid"), "tid", "left_semi")
    return keyed.upsert(records, known, "tid", order)


def resized(payload: Column, size: Column) -> Column:
    """Shrinking cuts the tail, growing fills with zero bytes."""
    missing = F.greatest(size - F.octet_length(payload), F.lit(0)).cast("int")
    return F.concat(F.substring(payload, F.lit(1), size), F.unhex(F.repeat(F.lit("00"), missing)))


def resize(records: DataFrame, sizes: DataFrame, order: str | None = None) -> DataFrame:
    """Resizes the records in ``sizes`` (tid, size); addresses stay.

    Of several sizes of a record the last by ``order`` counts, or the largest.
    """
    last = F.max_by("size", order) if order else F.max("size")
    met = records.join(sizes.groupBy("tid").agg(last.alias("_size")), "tid", "left")
    payload = F.when(F.col("_size").isNull(), F.col("payload")).otherwise(resized(F.col("payload"), F.col("_size")))
    return met.select("tid", payload.alias("payload"))


def erase(records: DataFrame, tids: DataFrame) -> DataFrame:
    return keyed.erase(records, tids, "tid")


def free_space(records: DataFrame, page_bytes: int = 1024) -> DataFrame:
    """``(page, used, free, class)`` of each page that holds records."""
    slots = F.count(F.lit(1)) * 8
    used = records.groupBy(bits.tid_page(F.col("tid")).alias("page")).agg((F.sum(F.octet_length("payload")) + slots).alias("used"))
    free = F.greatest(F.lit(page_bytes - bits.PAGE_HEADER_BYTES) - F.col("used"), F.lit(0))
    return used.withColumn("free", free).withColumn("class", bits.encode_free_space(F.col("free"), page_bytes))


def find_page(pages: DataFrame, size: int, page_bytes: int = 1024) -> DataFrame:
    """The first page whose class promises ``size`` bytes, or none."""
    fits = pages.filter(bits.decode_free_space(F.col("class"), page_bytes) >= size)
    return fits.agg(F.min("page").alias("page")).filter("page is not null")
