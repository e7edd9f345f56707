"""Intermediate tables in the shared folder that the cluster names.

Iterative and multi-pass operators cut their lineage by writing a table and
reading it back.  The folder is ``spark.checkpoint.dir``; only where a session
has none (tests on one machine) a temporary folder takes its place.  Written
tables survive the loss of executors.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _FALLBACK[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, whatever its scheme."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Workspace:
    """Tables of one run of one operator, below ``spark.checkpoint.dir``.

    ``save`` writes and rereads a frame, ``drop`` deletes tables that are no
    longer needed; what is left is deleted when the driver ends, because a
    lazily evaluated result may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._tables: set[str] = set()
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.load(name, df)

    def save_bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """A table in the workspace that is bucketed and sorted by ``keys``: joins on them need no exchange."""
        table = self._table(name)
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path(name)).saveAsTable(table)
        self._tables.add(table)
        return self.spark.table(table)

    def drop_bucketed(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self._tables.discard(self._table(name))
        self.drop(*names)

    def _table(self, name: str) -> str:
        return re.sub(r"\W", "_", f"{self.root.rpartition('/')[2]}_{name}")

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def drop_all(self) -> None:
        """Deletes all tables of this workspace, when no plan that is still to run reads them."""
        delete_path(self.spark, self.root)

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for table in self._tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has gone, and its folder with it
            pass


def own_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    free = next(n for n in count() if not any(f"_{name}_{n}" in taken for name in names))
    return {name: f"_{name}_{free}" for name in names}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
