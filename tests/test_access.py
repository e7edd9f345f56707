"""Keyed tables, records, catalog, u64 files, logs and streaming forms."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import keyed, locks, records
from corvane.sources import catalog, u64
from corvane.streaming import keyed as streaming


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_last_change_wins(spark):
    table = spark.createDataFrame([(k, 2 * k) for k in range(100)], "k long, v long")
    changes = spark.createDataFrame([(i % 120, i, i) for i in range(619)], "k long, v long, seq long")
    want = {k: 2 * k for k in range(100)} | {i % 120: i for i in range(619)}
    assert dict(pairs(keyed.upsert(table, changes, "k", "seq"))) == want


def test_lookup_and_erase(spark):
    table = spark.createDataFrame([(k, 2 * k) for k in range(124)], "k long, v long")
    assert pairs(keyed.lookup(table, "k", 7)) == [(7, 14)] and pairs(keyed.lookup(table, "k", 999)) == []
    assert pairs(keyed.erase(table, spark.range(0, 1000).select(F.col("id").alias("k")), "k")) == []
    assert pairs(keyed.erase_values(table, "k", range(2, 124))) == [(0, 0), (1, 2)]


def test_lookup_is_pushed_to_the_scan(spark, tmp_path):
    keyed.clustered(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v")), "k").write.parquet(str(tmp_path / "t"))
    plan = keyed.lookup(spark.read.parquet(str(tmp_path / "t")), "k", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,5)]" in plan


def test_records_resize(spark):
    rng = random.Random(0)
    kept = {t: bytes(rng.randrange(256) for _ in range(rng.randrange(1, 250))) for t in range(60)}
    df = spark.createDataFrame([(t, bytearray(p)) for t, p in kept.items()], "tid long, payload binary")
    sizes = {t: rng.randrange(0, 250) for t in range(0, 60, 2)}
    df = records.resize(df, spark.createDataFrame(list(sizes.items()), "tid long, size int"))
    want = {t: (p[: sizes[t]] + bytes(max(0, sizes[t] - len(p))) if t in sizes else p) for t, p in kept.items()}
    df = records.erase(df, spark.createDataFrame([(t,) for t in range(10)], "tid long"))
    changed = spark.createDataFrame([(20, bytearray(b"new"), 1), (999, bytearray(b"no"), 1)], "tid long, payload binary, seq int")
    df = records.write(df, changed, "seq")
    want = {t: p for t, p in want.items() if t >= 10} | {20: b"new"}
    assert {r["tid"]: bytes(r["payload"]) for r in df.collect()} == want
    assert bytes(records.read(df, 20).first()["payload"]) == b"new"


def test_catalog_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    catalog.Database(spark, root).load_new_schema(catalog.LIGHT_RETAIL)
    db = catalog.Database(spark, root)
    assert db.load_schema() == catalog.LIGHT_RETAIL
    db.insert("region", spark.createDataFrame([("1", "AFRICA", "x" * 200), ("2", "ASIA", "")], "a string, b string, c string"))
    db.insert("region", spark.createDataFrame([("3", "EUROPE", "y")], "a string, b string, c string"))
    found = db.table("region").orderBy("tid").collect()
    assert [r["r_regionkey"] for r in found] == [1, 2, 3] and len({r["tid"] for r in found}) == 3
    assert found[0]["r_comment"] == "x" * 152 and found[1]["r_name"] == "ASIA".ljust(25)
    assert db.read_tuple("region", found[2]["tid"]).first()[0] == f"3 | {'EUROPE'.ljust(25)} | {'y'.ljust(152)}"
    with pytest.raises(ValueError, match="invalid data"):
        db.insert("region", spark.createDataFrame([("1",)], "a string"))
    assert catalog.Schema.from_json('{"tables": [{"columns": [{}]}]}').tables["?"].columns == (catalog.Column("?"),)


def test_catalog_is_not_overwritten_unasked(spark, tmp_path):
    db = catalog.Database(spark, f"file://{tmp_path}/db")
    db.load_new_schema(catalog.LIGHT_RETAIL)
    rows = spark.createDataFrame([("1", None, "x")], "a string, b string, c string")
    given = db.insert("region", rows).collect()
    assert db.read_tuple("region", given[0]["tid"]).first()[0] == f"1 |  | {'x'.ljust(152)}"
    with pytest.raises(FileExistsError):
        db.load_new_schema(catalog.LIGHT_RETAIL)
    db.load_new_schema(catalog.LIGHT_RETAIL, overwrite=True)
    assert db.table("region").count() == 0


def test_repeated_sizes(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdef"))], "tid long, payload binary")
    sizes = spark.createDataFrame([(1, 5, 0), (1, 2, 1)], "tid long, size int, seq int")
    assert [bytes(r["payload"]) for r in records.resize(df, sizes, "seq").collect()] == [b"ab"]
    assert [bytes(r["payload"]) for r in records.resize(df, sizes).collect()] == [b"abcde"]


def test_u64_files(spark, tmp_path):
    u64.register(spark)
    path = f"file://{tmp_path}/values"
    numbers = [5, 2**64 - 1, 0, 2**63, 2**63 - 1, 7, 7]
    df = spark.createDataFrame([(str(n),) for n in numbers], "v string").select(F.col("v").cast("decimal(20,0)").alias("value"))
    u64.external_sort(df).write.format("u64").mode("overwrite").save(path)
    read = spark.read.format("u64").option("splitBytes", 16).load(path)
    assert [int(r[0]) for r in read.collect()] == sorted(numbers)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "values").iterdir()))
    assert raw == b"".join(n.to_bytes(8, "little") for n in sorted(numbers))
    assert spark.read.format("u64").option("limit", 3).load(path).count() == 3
    assert [int(r[0]) for r in u64.descending(spark, 3).collect()] == [3, 2, 1]
    assert pairs(u64.random_values(spark, 50)) == pairs(u64.random_values(spark, 50))
    assert u64.external_sort(df.limit(0)).count() == 0


def test_deadlocks(spark):
    def found(edges):
        return {r[0] for r in locks.deadlocked(spark.createDataFrame(edges, "waiter long, owner long")).collect()}

    assert found([(1, 2), (2, 1)]) == {1, 2}
    assert found([(1, 2), (2, 3), (3, 1), (4, 1), (3, 9)]) == {1, 2, 3}
    assert found([(0, 1), (1, 2), (2, 3), (1, 3)]) == set()
    assert found([(1, 2), (2, 1), (2, 5), (5, 6), (6, 7), (7, 6)]) == {1, 2, 6, 7}


def test_locks(spark):
    held = spark.createDataFrame([(0, 1, "Shared"), (0, 2, "Shared"), (1, 3, "Exclusive")], "item long, txn long, mode string")
    assert pairs(locks.lock_modes(held)) == [(0, "Shared", 2), (1, "Exclusive", 1)]
    wanted = spark.createDataFrame([(0, 5, "Shared"), (0, 6, "Exclusive"), (1, 1, "Shared")], "item long, txn long, mode string")
    edges = locks.waits_for(wanted, held)
    assert pairs(edges) == [(1, 3), (6, 1), (6, 2)]
    assert pairs(locks.without_transactions(edges, spark.createDataFrame([(1,)], "txn long"))) == [(6, 2)]


def _log(seed, rows, txns):
    r = random.Random(seed)
    log = [(r.randrange(5) if i % 3 else 77, r.randrange(txns), r.choice(["Shared", "Shared", "Exclusive"])) for i in range(rows)]
    return log + [(None, 1, "Exclusive"), (1, None, "Exclusive")]


def _met(wanted, held):
    known = [(a, b) for a in wanted for b in held if None not in (*a, *b) and a[0] == b[0] and a[1] != b[1]]
    return {(a[1], b[1]) for a, b in known if "Exclusive" in (a[2], b[2])}


@pytest.mark.parametrize(("held_rows", "marks"), [(locks.HELD_ROWS, locks.MARKS), (100, locks.MARKS), (100, 20), (1 << 20, 1)])
def test_edges_against_all_pairs(spark, held_rows, marks):
    wanted, held = _log(1, 300, 40), _log(2, 400, 50)
    schema = "item long, txn long, mode string"
    edges = pairs(locks.waits_for(spark.createDataFrame(wanted, schema), spark.createDataFrame(held, schema), held_rows, marks))
    assert edges == sorted(_met(wanted, held))


def test_edges_are_not_shuffled(spark):
    schema = "item long, txn string, mode string"
    wanted, held = ([(i, str(t), m) for i, t, m in _log(seed, 200, 30) if t is not None] for seed in (3, 4))
    a, b = spark.createDataFrame(wanted, schema), spark.createDataFrame(held, schema)
    gone = spark.createDataFrame([("3",), ("3",), ("7",)], "txn string")
    left = locks.waits_for_without(a, b, gone)
    assert pairs(left) == sorted(e for e in _met(wanted, held) if not {"3", "7"} & set(e))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition") < plan.index("Join")
    assert pairs(locks.waits_for(a, b.limit(0))) == pairs(locks.waits_for(a.limit(0), b)) == []


def test_blocks_meet_without_copies(spark, monkeypatch):
    monkeypatch.setattr(locks, "WANTED_ROWS", 30)
    few, many = _log(5, 120, 30), [(i % 7 if i < 40 else 1000 + i, i, "Exclusive" if i % 3 else "Shared") for i in range(600)]  # of most owners a waiter meets few
    wanted, held = spark.createDataFrame(few, "item int, txn int, mode string"), spark.createDataFrame(many, "item long, txn long, mode string")
    edges = locks.waits_for(wanted, held, 50)
    assert pairs(edges) == sorted(_met(few, many))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") == 0 and plan.count("Generate") == 1  # lists of owners are taken apart, but no lock or request is multiplied


def test_blocks_meet_without_transactions_that_are_gone(spark):
    few, many = _log(6, 150, 30), _log(7, 200, 40)
    wanted, held = (spark.createDataFrame(log, "item long, txn long, mode string") for log in (few, many))
    edges = locks.waits_for_without(wanted, held, held.filter("txn % 4 = 0").union(wanted.filter("txn % 4 = 0")))
    assert pairs(edges) == sorted(e for e in _met(few, many) if e[0] % 4 and e[1] % 4)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("LeftAnti")


def test_cache_queues(spark):
    log = [(0, i, p) for i, p in enumerate([1, 2, 3, 2, 1, 2])]
    found = {r["page"]: (r["queue"], r["at"]) for r in locks.cache_queues(spark.createDataFrame(log, "pool long, seq long, page long")).collect()}
    assert found == {1: ("lru", 4), 2: ("lru", 5), 3: ("fifo", 2)}


def test_streaming_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"2024-01-0{1 + i // 10} 00:00:00", i % 2, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, k long, v double").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    counted = streaming.windowed_counts(stream, "t", "k", "v", "1 day", "0 seconds")
    streaming.to_parquet(counted, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.sum("n")).first()[0] == 30  # the last day's window is still open
    assert pairs(streaming.latest_by_key(df.withColumn("seq", F.col("v")), "k", "seq").select("k", "v")) == [(0, 38.0), (1, 39.0)]
