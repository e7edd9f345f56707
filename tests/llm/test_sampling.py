"""Samples are the first rows by a hash, whether or not a threshold cut the table before."""

import pytest

from corvane.llm import sampling

from .common import hashed


@pytest.mark.parametrize("limit", [1, 50, 4000])
def test_first_by_hash(spark, limit):
    df = spark.range(5000).selectExpr("id * 7 AS doc_id", "id % 3 AS lang")
    got = [r["doc_id"] for r in sampling.sample_ids(df, limit).collect()]
    order = sorted(range(0, 35_000, 7), key=lambda d: hashed(d, "sample"))
    if limit > 2000:
        assert got == order[:limit]
    else:  # of the rows below the threshold, which is of the unsigned half
        assert len(got) == limit and got == [d for d in order if d in set(got)]
    assert got == [r["doc_id"] for r in sampling.sample_ids(df.repartition(7), limit).collect()]


def test_few_rows_and_hot_ids(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 0)], "doc_id long, x int")
    assert sampling.sample_ids(df, 20).count() == 20 and sampling.sample_ids(df.limit(0), 5).count() == 0
    assert sampling.sample_ids(df, 1000).count() == 301


def test_held_out(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "doc_id long")
    assert [r[0] for r in df.filter("doc_id is null").select(sampling.held_out(df["doc_id"])).collect()] == [False]
