"""The relational algebra, by attribute position, as lazy DataFrame plans.

Nothing here executes: every function returns a plan that Catalyst optimises,
with pushed-down filters, pruned columns and its own choice of join strategy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.plans.positional import at, numbered, unique_names
from corvane.types import char, is_text

JOIN_PARTS = 96
BLOCK_ROWS = 1 << 12  # of a key, on either side of a join; one that has more is cut
PLACES = 4 * JOIN_PARTS  # that the matches of all keys that are cut are spread over, whatever their number
LIST_ROWS = 1 << 9  # of one key, which meet a row of the other side at once
COMPARISONS = {
    "EQ": lambda a, b: a == b,
    "NE": lambda a, b: a != b,
    "LT": lambda a, b: a < b,
    "LE": lambda a, b: a <= b,
    "GT": lambda a, b: a > b,
    "GE": lambda a, b: a >= b,
}


def print_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """Each row as one line, its attributes joined by commas, nulls as nothing; write it with ``.write.text``."""
    return df.select(F.concat_ws(",", *(F.coalesce(at(df, i).cast("string"), F.lit("")) for i in range(len(df.columns)))).alias(column))


def projection(df: DataFrame, indexes: Sequence[int]) -> DataFrame:
    """The attributes at ``indexes``, in that order, repeats included; a bag."""
    names = unique_names([df.columns[i] for i in indexes])
    return df.select(*(at(df, i).alias(name) for i, name in zip(indexes, names, strict=True)))


def _compared(left: Column, right: Column, operator: str, same_kind: bool) -> Column:
    """Values of different kinds are unequal; they have no order."""
    if same_kind:
        return COMPARISONS[operator](left, right)
    if operator not in ("EQ", "NE"):
        raise TypeError("values of different kinds can't be ordered")
    return F.lit(operator == "NE")


def select_int(df: DataFrame, index: int, operator: str, constant: int) -> DataFrame:
    """Rows whose attribute compares so with an integer."""
    text = is_text(df.schema[index].dataType)
    return df.filter(_compared(at(df, index), F.lit(constant).cast("long"), operator, not text))


def select_char(df: DataFrame, index: int, operator: str, constant: str, length: int = 16) -> DataFrame:
    """Rows whose fixed-width attribute compares so with a string, both padded."""
    text = is_text(df.schema[index].dataType)
    return df.filter(_compared(char(at(df, index), length) if text else at(df, index), char(F.lit(constant), length), operator, text))


def select_attributes(df: DataFrame, left: int, right: int, operator: str) -> DataFrame:
    """Rows two of whose attributes compare so."""
    same = is_text(df.schema[left].dataType) == is_text(df.schema[right].dataType)
    return df.filter(_compared(at(df, left), at(df, right), operator, same))


def sort(df: DataFrame, criteria: Sequence[tuple[int, bool]], ties: Sequence[str] = ()) -> DataFrame:
    """Rows by ``(index, descending)`` criteria, the first most significant.

    Spark keeps no input order among equals; name the columns that hold it in
    ``ties`` for a stable result.
    """
    keys = [at(df, i).desc_nulls_last() if down else at(df, i).asc_nulls_first() for i, down in criteria]
    return df.orderBy(*keys, *ties)


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of an ordered relation with their places, from 1.

    The relation is written to the session's checkpoint folder once, as it is
    ordered; a row's place is its number in its part and the rows of the parts
    before it, of which there is one count each.
    """
    rows = ordered.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    counts = rows.groupBy(part.alias("_part")).count()
    ahead = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_ahead"))  # one row a part
    found = rows.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return found.select(*(at(found, found.columns.index(c)) for c in ordered.columns), (F.col("_ahead") + inside + 1).alias(name))


def hash_join(left: DataFrame, right: DataFrame, left_index: int, right_index: int) -> DataFrame:
    """Inner join on one pair of attributes: all attributes of ``left``, then all of ``right``."""
    a, b = numbered(left), numbered(right, len(left.columns))
    same = is_text(left.schema[left_index].dataType) == is_text(right.schema[right_index].dataType)
    joined = a.join(b, (at(a, left_index) == at(b, right_index)) if same else F.lit(False), "inner")
    return joined.toDF(*unique_names([*left.columns, *right.columns]))


def _cuts(a: DataFrame, b: DataFrame, left_index: int, right_index: int, block_rows: int) -> DataFrame:
    """``(key, m, n)``: the blocks of either side for keys that have more than ``block_rows`` rows on one.

    A key gets its share of ``PLACES`` by its matches.  How often a row is copied follows from
    that number and how the two sides compare, not from how many rows there are.
    """
    counted = lambda df, key, n: df.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias(n))
    hot = counted(a, at(a, left_index), "l").join(counted(b, at(b, right_index), "r"), "key").filter(F.greatest("l", "r") > block_rows)
    all_hot = hot.agg(F.sum(F.col("l") * F.col("r")).alias("pairs"))
    shared = hot.crossJoin(F.broadcast(all_hot)).select("key", "l", "r", F.ceil(PLACES * F.col("l") * F.col("r") / F.col("pairs")).cast("int").alias("places"))
    m = F.least("places", F.greatest(F.lit(1), F.round(F.sqrt(F.col("places") * F.col("l") / F.col("r"))).cast("int")))
    return shared.withColumn("m", m).select("key", "m", F.ceil(F.col("places") / F.col("m")).cast("int").alias("n"))


def hash_join_dup(left: DataFrame, right: DataFrame, left_index: int, right_index: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``hash_join`` for keys that repeat on both sides and have too many matches for one task.

    Rows of keys with more than ``block_rows`` of them on one side are cut, by a hash of the whole
    row, into blocks, and each block meets each of the other side in a place of its own.  The
    places are spread over ``JOIN_PARTS`` tasks.  Rows that are equal throughout stay in one block.
    In a place the left rows are lists of ``LIST_ROWS``: a list is taken apart for one right row after
    the other, so that columnar files of the result hold short runs that repeat, and stay small.
    """
    if is_text(left.schema[left_index].dataType) != is_text(right.schema[right_index].dataType):
        return hash_join(left, right, left_index, right_index)
    a, b = numbered(left), numbered(right, len(left.columns))
    cuts = _cuts(a, b, left_index, right_index, block_rows)

    def dealt(df: DataFrame, index: int, own: str, other: str) -> DataFrame:
        parts = lambda n: F.coalesce(F.col(n), F.lit(1))
        found = df.filter(at(df, index).isNotNull()).join(cuts, at(df, index) == F.col("key"), "left")
        block = F.pmod(F.xxhash64(*df.columns), parts(own)).cast("int").alias(own)
        rows = found.select(*df.columns, block, F.explode(F.sequence(F.lit(0), parts(other) - 1)).alias(other))
        return rows.repartition(JOIN_PARTS, df.columns[index], "m", "n")

    x, y, key = dealt(a, left_index, "m", "n"), dealt(b, right_index, "n", "m"), a.columns[left_index]
    row = F.row_number().over(W.partitionBy(key, "m", "n").orderBy(F.xxhash64(*a.columns)))
    lists = x.withColumn("list", F.floor((row - 1) / LIST_ROWS)).groupBy(key, "m", "n", "list").agg(F.collect_list(F.struct(*a.columns)).alias("rows"))
    met = lists.hint("merge").join(y, (lists[key] == at(y, right_index)) & (lists["m"] == y["m"]) & (lists["n"] == y["n"]))
    return met.select(F.inline("rows"), *b.columns).toDF(*unique_names([*left.columns, *right.columns]))


def hash_aggregate(df: DataFrame, group_by: Sequence[int], functions: Sequence[tuple[str, int, str]]) -> DataFrame:
    """Group attributes, then ``(function, index, name)`` aggregates: MIN, MAX, SUM (integers) or COUNT (rows).

    Without group attributes: one row, or none for an empty relation.
    """
    made = {
        "MIN": lambda c: F.min(c),
        "MAX": lambda c: F.max(c),
        "SUM": lambda c: F.sum(c.cast("long")),
        "COUNT": lambda c: F.count(F.lit(1)),
    }
    for function, index, _ in functions:
        if function == "SUM" and is_text(df.schema[index].dataType):
            raise TypeError("SUM is for integers")
    aggregates = [made[function](at(df, index)).alias(name) for function, index, name in functions]
    keys = [at(df, i) for i in group_by]
    if not aggregates:
        return df.select(*keys).distinct()
    if keys:
        return df.groupBy(*keys).agg(*aggregates)
    return df.agg(*aggregates, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersectAll(right)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)
