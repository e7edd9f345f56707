"""A declared-schema catalog: named tables with typed columns and a primary key.

Schemas are stored as JSON beside the tables.  Rows arrive as strings; they
are cast to the declared types, padded or cut to the declared widths, and
appended as Parquet with a record address (``tid``) each.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.types import char

BATCH_BITS = 48  # a tid is the number of its insert, then the row's number in it: 15 bits of partition, 33 of row
MOST_PARTITIONS = 1 << 15


@dataclass(frozen=True)
class Column:
    """``kind`` is ``integer`` or ``char``; ``length`` is for char columns."""

    id: str
    kind: str = "integer"
    length: int = 0

    def spark_type(self) -> T.DataType:
        return T.IntegerType() if self.kind == "integer" else T.StringType()


@dataclass(frozen=True)
class Table:
    id: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("tid", T.LongType()), *(T.StructField(c.id, c.spark_type()) for c in self.columns)])


@dataclass
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)

    @classmethod
    def of(cls, *tables: Table) -> Schema:
        return cls({t.id: t for t in tables})

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()]})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        """Missing fields take defaults: name ``?``, kind integer, length 0, no key."""
        tables = []
        for t in json.loads(text).get("tables", []):
            columns = tuple(Column(c.get("id", "?"), c.get("kind", "integer"), c.get("length", 0)) for c in t.get("columns", []))
            tables.append(Table(t.get("id", "?"), columns, tuple(t.get("primary_key", []))))
        return cls.of(*tables)

    def describe(self, spark: SparkSession) -> DataFrame:
        """A row for each column: table, position, column, kind, length, in_key."""
        rows = [(t.id, i, c.id, c.kind, c.length, c.id in t.primary_key) for t in self.tables.values() for i, c in enumerate(t.columns)]
        return spark.createDataFrame(rows, "table_id string, position int, column_id string, kind string, length int, in_key boolean")


#: The three tables of the light retail schema.
LIGHT_RETAIL = Schema.of(
    Table(
        "customer",
        (
            Column("c_custkey"), Column("c_name", "char", 25), Column("c_address", "char", 40), Column("c_nationkey"),
            Column("c_phone", "char", 15), Column("c_acctbal"), Column("c_mktsegment", "char", 10), Column("c_comment", "char", 117),
        ),
        ("c_custkey",),
    ),
    Table("nation", (Column("n_nationkey"), Column("n_name", "char", 25), Column("n_regionkey"), Column("n_comment", "char", 152)), ("n_nationkey",)),
    Table("region", (Column("r_regionkey"), Column("r_name", "char", 25), Column("r_comment", "char", 152)), ("r_regionkey",)),
)


def typed_rows(rows: DataFrame, table: Table) -> DataFrame:
    """Rows of strings as the table's types; as many values as columns, or an error."""
    if len(rows.columns) != len(table.columns):
        raise ValueError(f"invalid data: {len(rows.columns)} values for {len(table.columns)} columns")
    values = [rows[name] for name in rows.columns]
    made = [v.cast("int") if c.kind == "integer" else char(v, c.length) for v, c in zip(values, table.columns, strict=True)]
    return rows.select(*(v.alias(c.id) for v, c in zip(made, table.columns, strict=True)))


class Database:
    """Tables below a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), Schema()

    def load_new_schema(self, schema: Schema, overwrite: bool = False) -> None:
        """Stores the schema and makes its tables, without rows; what is stored there already goes only with ``overwrite``."""
        if not overwrite and self._exists("_schema.json"):
            raise FileExistsError(f"{self.root} holds a schema")
        self.schema = schema
        self.spark.createDataFrame([(schema.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_schema.json")
        for table in schema.tables.values():
            self.spark.createDataFrame([], table.struct()).write.mode("overwrite").parquet(f"{self.root}/{table.id}")

    def load_schema(self) -> Schema:
        """Opens what is stored; its tables can be read and inserted into."""
        self.schema = Schema.from_json(self.spark.read.text(f"{self.root}/_schema.json", wholetext=True).first()[0])
        return self.schema

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema.tables[name].struct()).parquet(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Appends rows of strings and returns their addresses (tid), each above all earlier ones.

        Addresses hold for up to 2**15 inserts of up to 2**15 partitions; larger
        inserts are dealt anew.  One insert at a time: of two that overlap the later fails.
        """
        stored = self.table(name)
        last = stored.agg(F.max("tid")).first()[0]
        batch = 0 if last is None else (last >> BATCH_BITS) + 1
        if batch >= 1 << (63 - BATCH_BITS):
            raise OverflowError(f"{name} has no address left for another insert; write it anew")
        typed = typed_rows(rows, self.schema.tables[name]).coalesce(MOST_PARTITIONS)  # fewer stay as they are
        first = F.lit(batch << BATCH_BITS).cast("long")
        claim = f"{self.root}/_inserts/{name}-{batch}"
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("errorifexists").parquet(claim)
        typed.select((first + F.monotonically_increasing_id()).alias("tid"), "*").write.mode("append").parquet(f"{self.root}/{name}")
        return self.table(name).filter(F.col("tid") >= batch << BATCH_BITS).filter(F.col("tid") < (batch + 1) << BATCH_BITS).select("tid")

    def read_tuple(self, name: str, tid: int) -> DataFrame:
        """The record at an address as one line, its values separated by `` | ``, nulls as nothing."""
        columns = [F.coalesce(F.col(c.id).cast("string"), F.lit("")) for c in self.schema.tables[name].columns]
        return self.table(name).filter(F.col("tid") == tid).select(F.concat_ws(" | ", *columns).alias("line"))
