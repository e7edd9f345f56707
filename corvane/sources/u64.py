"""Files of unsigned 64-bit little-endian integers, as a Spark data source.

``spark.read.format("u64").load(path)`` reads a file or a folder in byte
ranges, a task each, into one column ``value DECIMAL(20, 0)``;
``df.write.format("u64").save(path)`` writes a file a task, named so that a
folder read in name order keeps the order of the partitions.  Sorting is
Spark's own: range partitioning, sorting in each task, spilling as needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corvane.types import U64

VALUE_BYTES = 8
SPLIT_BYTES = 64 << 20
BATCH_VALUES = 1 << 16


def _resolve(path: str, default: str) -> tuple[pafs.FileSystem, str]:
    """A path without a scheme belongs to the session's default file system, as everywhere in Spark."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        path = default.rstrip("/") + "/" + path.lstrip("/") if not default.startswith("file:") else f"file://{path}"
    elif rest.startswith("/") and not rest.startswith("//"):
        path = f"{scheme}://{rest}"
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, default: str):
        self.path, self.default, self.limit = options["path"], default, int(options.get("limit", -1))
        self.split = int(options.get("splitbytes", SPLIT_BYTES)) // VALUE_BYTES * VALUE_BYTES

    def partitions(self) -> list[_Range]:
        files, path = _resolve(self.path, self.default)
        info = files.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(path))
        ranges, left = [], self.limit * VALUE_BYTES if self.limit >= 0 else None
        for f in sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            size = f.size // VALUE_BYTES * VALUE_BYTES
            size = size if left is None else min(size, left)
            left = None if left is None else left - size
            ranges += [_Range(f.path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        files, _ = _resolve(self.path, self.default)
        with files.open_input_file(partition.path) as source:
            for at in range(partition.start, partition.end, BATCH_VALUES * VALUE_BYTES):
                data = source.read_at(min(BATCH_VALUES * VALUE_BYTES, partition.end - at), at)
                values = pa.array(np.frombuffer(data, dtype="<u8"))
                yield pa.RecordBatch.from_arrays([values.cast(pa.decimal128(20, 0))], names=["value"])


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, default: str):
        self.path, self.overwrite, self.default = options["path"], overwrite, default

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, path = _resolve(self.path, self.default)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.{context.taskAttemptId()}.u64"
        files.create_dir(f"{path}/_temporary", recursive=True)
        with files.open_output_stream(f"{path}/_temporary/{name}") as out:
            for batch in iterator:
                if batch.column(0).null_count:
                    raise ValueError("a null is no unsigned integer")
                out.write(batch.column(0).cast(pa.uint64()).to_numpy(zero_copy_only=False).astype("<u8").tobytes())
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = _resolve(self.path, self.default)
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File:
                    files.delete_file(f.path)
        for message in messages:
            if message:
                files.move(f"{path}/_temporary/{message.name}", f"{path}/{message.name}")
        self._clean(files, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*_resolve(self.path, self.default))

    @staticmethod
    def _clean(files: pafs.FileSystem, path: str) -> None:
        if files.get_file_info(f"{path}/_temporary").type == pafs.FileType.Directory:
            files.delete_dir(f"{path}/_temporary")


class U64Source(DataSource):
    """Options: ``path``, ``limit`` (first values only, -1: all), ``splitBytes`` (bytes a task)."""

    default_fs = "file:///"

    @classmethod
    def name(cls) -> str:
        return "u64"

    def schema(self) -> str:
        return "value decimal(20,0)"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.default_fs)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, self.default_fs)


def register(spark: SparkSession) -> None:
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    spark.dataSource.register(type("SessionU64Source", (U64Source,), {"default_fs": default}))


def descending(spark: SparkSession, n: int) -> DataFrame:
    """n, n - 1, ..., 1."""
    return spark.range(n, 0, -1).select(F.col("id").cast(U64).alias("value"))


def random_values(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n pseudorandom values over the whole range, the same for each seed."""
    return spark.range(n).select(as_unsigned(F.xxhash64(F.col("id"), F.lit(seed))).alias("value"))


def as_unsigned(value: Column) -> Column:
    """A signed 64-bit column read as unsigned."""
    wide = value.cast("decimal(21,0)")
    return F.when(wide < 0, wide + F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide).cast(U64)


def external_sort(values: DataFrame, column: str = "value") -> DataFrame:
    """Values in ascending unsigned order; write the result to keep the order in the files' names.

    Rows travel and are sorted as signed 64-bit numbers, moved by 2**63 so that
    their order is the unsigned one.  Other columns stay.
    """
    half = F.lit(str(2**63)).cast("decimal(20,0)")
    moved = values.withColumn(column, (F.col(column).cast(U64) - half).cast("long"))
    return moved.orderBy(F.col(column).asc()).withColumn(column, (F.col(column).cast("decimal(20,0)") + half).cast(U64))
