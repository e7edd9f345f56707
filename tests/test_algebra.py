"""The algebra on small relations with known results."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import algebra
from corvane.sources.tuples import tuples
from corvane.types import INT64

TEXT = T.StringType()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def students(spark):
    return tuples(spark, [(24002, "Xenokrates".ljust(16)), (26120, "Fichte".ljust(16)), (29555, "Feuerbach".ljust(16))], [INT64, TEXT])


@pytest.fixture(scope="module")
def grades(spark):
    return tuples(spark, [(24002, 5001, 1), (24002, 5041, 2), (29555, 4630, 2)], [INT64] * 3)


def ints(spark, values):
    return tuples(spark, [(v,) for v in values], [INT64])


def test_print_keeps_padding(students):
    assert rows(algebra.print_lines(students))[0] == ("24002,Xenokrates      ",)


def test_projection_orders_and_repeats(students):
    assert rows(algebra.projection(students, [0])) == [(24002,), (26120,), (29555,)]
    swapped = algebra.projection(students, [1, 0, 0])
    assert swapped.columns == ["c1", "c0", "c0_1"]
    assert rows(swapped)[1] == ("Fichte".ljust(16), 26120, 26120)
    with pytest.raises(IndexError):
        algebra.projection(students, [2])


@pytest.mark.parametrize(
    ("operator", "kept"), [("EQ", {26120}), ("NE", {24002, 29555}), ("LT", {24002}), ("LE", {24002, 26120}), ("GT", {29555}), ("GE", {26120, 29555})]
)
def test_select_int(students, operator, kept):
    assert {r[0] for r in rows(algebra.select_int(students, 0, operator, 26120))} == kept


def test_select_char_pads(students):
    assert [r[0] for r in rows(algebra.select_char(students, 1, "EQ", "Feuerbach"))] == [29555]
    assert {r[0] for r in rows(algebra.select_char(students, 1, "LT", "Fichte"))} == {29555}


def test_select_attributes(spark):
    numbers = tuples(spark, [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 2)], [INT64] * 2)
    assert sorted(rows(algebra.select_attributes(numbers, 0, 1, "GE"))) == [(1, 1), (2, 1), (3, 2)]


def test_kinds_that_differ(students):
    assert rows(algebra.select_attributes(students, 0, 1, "EQ")) == []
    assert len(rows(algebra.select_char(students, 0, "NE", "x"))) == 3
    with pytest.raises(TypeError):
        algebra.select_int(students, 1, "LT", 3)


def test_sort(grades):
    assert rows(algebra.sort(grades, [(0, True), (2, False)])) == [(29555, 4630, 2), (24002, 5001, 1), (24002, 5041, 2)]


def test_sort_is_stable_with_ties(spark):
    df = tuples(spark, [(i, i % 3) for i in range(200)], [INT64] * 2)
    assert rows(algebra.sort(df, [(1, True)], ["c0"])) == sorted(((i, i % 3) for i in range(200)), key=lambda r: -r[1])


def test_join_keeps_all_matches(spark, students, grades):
    joined = algebra.hash_join(students, grades, 0, 0)
    assert joined.columns == ["c0", "c1", "c0_1", "c1_1", "c2"]
    assert len(rows(joined)) == 3
    both = algebra.hash_join(ints(spark, [1, 1, 2]), ints(spark, [1, 1, 3]), 0, 0)
    assert rows(both) == [(1, 1)] * 4
    assert rows(algebra.hash_join(students, grades, 1, 0)) == []


def test_aggregates(spark, students, grades):
    found = algebra.hash_aggregate(students, [], [("MIN", 1, "a"), ("MAX", 1, "b")])
    assert rows(found) == [("Feuerbach".ljust(16), "Xenokrates".ljust(16))]
    assert sorted(rows(algebra.hash_aggregate(grades, [0], [("SUM", 2, "s"), ("COUNT", 0, "n")]))) == [(24002, 3, 2), (29555, 2, 1)]
    assert rows(algebra.hash_aggregate(ints(spark, []), [], [("COUNT", 0, "n")])) == []
    assert sorted(rows(algebra.hash_aggregate(grades, [0], []))) == [(24002,), (29555,)]
    with pytest.raises(TypeError):
        algebra.hash_aggregate(students, [], [("SUM", 1, "s")])


SETS = {
    algebra.union: lambda m, n: int(m + n > 0), algebra.union_all: lambda m, n: m + n, algebra.intersect: lambda m, n: int(m > 0 and n > 0),
    algebra.intersect_all: min, algebra.except_: lambda m, n: int(m > 0 and n == 0), algebra.except_all: lambda m, n: max(m - n, 0),
}


@pytest.mark.parametrize("operator", SETS)
def test_set_operations(spark, operator):
    left, right = [1, 1, 2, 3, 3, 3], [2, 4, 4, 3, 3]
    found = Counter(r[0] for r in rows(operator(ints(spark, left), ints(spark, right))))
    a, b = Counter(left), Counter(right)
    assert found == Counter({k: n for k in a | b if (n := SETS[operator](a[k], b[k]))})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), max_size=12), st.lists(st.integers(-3, 3), max_size=12))
def test_set_multiplicities(spark, left, right):
    a, b = Counter(left), Counter(right)
    for operator in (algebra.intersect_all, algebra.except_all):
        found = Counter(r[0] for r in rows(operator(ints(spark, left), ints(spark, right))))
        assert found == Counter({k: n for k in a | b if (n := SETS[operator](a[k], b[k]))})


def test_places_come_of_the_sort(spark):
    from corvane.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    r = random.Random(7)
    df = spark.createDataFrame([(r.randrange(50), i) for i in range(2000)], "k long, i long").repartition(5)
    got = [tuple(x) for x in algebra.placed(algebra.sort(df, [(0, True)], ["i"])).collect()]
    want = sorted(((x["k"], x["i"]) for x in df.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(*x, n) for n, x in enumerate(want, 1)]
    assert algebra.placed(df.limit(0).orderBy("k")).count() == 0


def test_print_keeps_the_places_of_nulls(spark):
    assert [x[0] for x in algebra.print_lines(spark.createDataFrame([(1, None, 3)], "a int, b int, c int")).collect()] == ["1,,3"]


def test_keys_with_many_matches_are_spread(spark):
    left = spark.range(300).select(F.when(F.col("id") < 290, 7).when(F.col("id") < 295, F.col("id")).alias("k"), (F.col("id") % 97).alias("v"))
    right = spark.range(400).select((F.col("id") % 50).alias("v"), F.when(F.col("id") < 390, 7).when(F.col("id") < 395, F.col("id") - 100).alias("k"))
    found = algebra.hash_join_dup(left, right, 0, 1, block_rows=20)
    plain = algebra.hash_join(left, right, 0, 1)
    assert found.columns == plain.columns and found.count() == 290 * 390 + 5
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 290 * 390 / 8
    texts = left.select(F.col("k").cast("string").alias("k"))
    assert algebra.hash_join_dup(texts, right, 0, 1).isEmpty()


def test_rows_are_copied_as_often_for_more_of_them(spark):
    def copied(rows):
        a, b = (algebra.numbered(spark.range(n).select((F.col("id") % 4).alias("k"), "id"), at) for n, at in ((rows, 0), (4 * rows, 2)))
        blocks = {r["key"]: (r["m"], r["n"]) for r in algebra._cuts(a, b, 0, 0, 20).collect()}
        assert len(blocks) == 4 and all(m * n >= algebra.PLACES / 4 for m, n in blocks.values())
        return max(max(x) for x in blocks.values())

    assert copied(200) == copied(20_000) <= 20


def test_files_of_many_matches_are_small(spark, tmp_path):
    left = spark.range(3001).select((F.col("id") * 7919).alias("a"), F.lit(1).alias("k"))
    right = spark.createDataFrame([(None, -1)] * 9, "k int, b long").union(spark.range(2003).select(F.lit(1).alias("k"), (F.col("id") * 7919).alias("b")))
    algebra.hash_join_dup(left, right, 1, 0, block_rows=5000).write.parquet(f"{tmp_path}/met")
    met = spark.read.parquet(f"{tmp_path}/met")
    assert met.count() == 3001 * 2003 and met.agg(F.count_distinct("a", "b")).first()[0] == 3001 * 2003
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 3001 * 2003 / 2
