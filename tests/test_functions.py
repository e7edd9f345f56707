"""Expressions against Python's integers and doubles, and bit fields."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import bits
from corvane.functions import expressions as E


def signed(x):
    return (x + 2**63) % 2**64 - 2**63


def test_integers_wrap(spark):
    rng = random.Random(0)
    edge = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, -(2**32), 2**31]
    pairs = [(a, b) for a in edge for b in edge] + [(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = E.argument(0), E.argument(1)
    made = df.select("a", "b", (a + b).on(df).alias("s"), (a - b).on(df).alias("d"), (a * b).on(df).alias("p"))
    for r in made.collect():
        assert (r["s"], r["d"], r["p"]) == (signed(r["a"] + r["b"]), signed(r["a"] - r["b"]), signed(r["a"] * r["b"]))


def test_division_truncates(spark):
    df = spark.createDataFrame([(42, 21), (-42, 21), (42, -21), (-7, 2), (7, -2)], "a long, b long")
    assert [r[0] for r in df.select((E.argument(0) / E.argument(1)).on(df)).collect()] == [2, -2, -2, -3, -3]


def test_real_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (6.0, 4.0)], "a double, b double")
    found = [r[0] for r in df.select((E.argument(0, E.REAL) / E.argument(1, E.REAL)).on(df)).collect()]
    assert found[:3] == [math.inf, -math.inf, -math.inf] and math.isnan(found[3]) and found[4] == 1.5


def test_casts(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,)], "a double")
    x = E.argument(0, E.REAL)
    assert [r[0] for r in df.select(E.cast(x, E.LONG).on(df)).collect()] == [2, -2]
    assert E.cast(E.integer(2**53 + 1), E.REAL).kind == E.REAL
    with pytest.raises(TypeError):
        E.integer(1) + E.real(1)


def test_random_expression(spark):
    rng = random.Random(0)
    data = [tuple(rng.randrange(-(2**63), 2**63) for _ in range(3)) + (rng.randrange(1, 2**63),) for _ in range(300)]
    df = spark.createDataFrame(data, "a long, b long, c long, d long")
    a = [E.argument(i) for i in range(4)]
    found = df.select(((((E.integer(42) + a[1]) * (E.integer(21) - a[0]) * a[2]) + E.integer(100)) / a[3]).on(df)).collect()
    for r, (x, y, z, w) in zip(found, data, strict=True):
        top = signed(signed((42 + y) * (21 - x) * z) + 100)
        assert r[0] == abs(top) // w * (1 if top >= 0 else -1)


def chained(n, rng, columns=3):
    """A left-deep expression of ``n`` operations and its value for a row."""
    steps = [(rng.choice("+-*"), rng.randrange(columns) if rng.random() < 0.5 else None, rng.randrange(1, 100)) for _ in range(n)]
    expression = E.argument(0)
    for operator, index, constant in steps:
        expression = E.Binary.of(operator, expression, E.integer(constant) if index is None else E.argument(index))

    def value(row):
        x = row[0]
        for operator, index, constant in steps:
            y = constant if index is None else row[index]
            x = signed(x + y if operator == "+" else x - y if operator == "-" else x * y)
        return x

    return expression, value


@pytest.mark.parametrize("n", [1, 63, 65, 1000])
def test_long_chains(spark, n):
    rng = random.Random(n)
    data = [tuple(rng.randrange(-(2**63), 2**63) for _ in range(3)) for _ in range(50)]
    df = spark.createDataFrame(data, "a long, b long, _step_1 long")
    expression, value = chained(n, rng)
    made = E.evaluate(df, expression, "v")
    assert made.columns == ["a", "b", "_step_1", "v"] and spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert [r["v"] for r in made.collect()] == [value(r) for r in data]
    assert len(made._jdf.queryExecution().analyzed().toString()) < 4000 + 3000 * n


def test_modes_inside_one_expression(spark):
    """Sums wrap below and above a division, which still raises; casts too."""
    df = spark.createDataFrame([(2**63 - 1, 1), (5, 3)], "a long, b long")
    a, b = E.argument(0), E.argument(1)
    wide = ((a + b) / b + a) * b
    assert [r["v"] for r in E.evaluate(df, wide, "v").collect()] == [signed(-(2**63) + 2**63 - 1), (8 // 3 + 5) * 3]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        E.evaluate(df, a / (b - b), "v").collect()
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        E.evaluate(df, E.cast(E.cast(a + b, E.REAL) * E.real(1e10), E.LONG) + a, "v").collect()
    x = E.cast(a, E.REAL)
    half = x
    for _ in range(80):  # quotients of quotients stay linear
        half = half / (E.real(1) + E.real(1)) + x
    assert len(E.evaluate(df, half, "v")._jdf.queryExecution().optimizedPlan().toString()) < 300_000
    want = 5.0
    for _ in range(80):
        want = want / 2 + 5.0
    assert E.evaluate(df, half, "v").filter("a = 5").first()["v"] == want
    assert E.evaluate(df, a + b, "b").columns == ["a", "b"]


def test_class_floors(spark):
    floors = bits.class_floors(1024)
    assert floors == [0, 7, 15, 31, 63, 126, 253, 506, 571, 634, 697, 760, 823, 886, 949, 1012]
    df = spark.range(1024).select("id", bits.encode_free_space(F.col("id")).alias("c")).select("id", bits.decode_free_space(F.col("c")).alias("f"))
    assert all(r["f"] == max(f for f in floors if f <= r["id"]) for r in df.collect())


def test_addresses(spark):
    df = spark.createDataFrame([(5, 3, 9), (2**40, 65535, 65535)], "page long, slot int, seg int")
    t = bits.tid(F.col("page"), F.col("slot"))
    pid = bits.page_number(F.col("seg"), F.col("page"))
    for r in df.select("*", bits.tid_page(t).alias("p"), bits.tid_slot(t).alias("s"), bits.segment_of(pid).alias("g"), bits.page_in_segment(pid).alias("q")).collect():
        assert (r["p"], r["s"], r["g"], r["q"]) == (r["page"], r["slot"], r["seg"], r["page"])
    v = bits.slot(F.col("page") % 1000, F.col("slot"), 254, 7)
    assert [tuple(r) for r in df.select(*bits.slot_fields(v).values()).collect()] == [(254, 7, 5, 3), (254, 7, 2**40 % 1000, 65535)]


def test_hex_dump(spark):
    df = spark.createDataFrame([(bytearray(b"abc\x00defghijklmno\x7fpq\xe9"),), (bytearray(b""),), (bytearray(range(200)),)], "b binary")
    lines = [r[0] for r in df.select(bits.hex_dump(F.col("b"))).collect()]
    assert lines[0][0] == "0000 : abc.defghijklmno 61 62 63 00 64 65 66 67 68 69 6A 6B 6C 6D 6E 6F "
    assert lines[0][1] == "0010 : \x7fpq." + " " * 12 + " 7F 70 71 E9 " and lines[1] == []
    assert lines[2][11].startswith("00B0 : " + "." * 16 + " B0 ")


def test_slot_flags_and_places(spark):
    empty, moved, target = -(1 << 56), (5 << 16) + 3, (0xFF << 56 | 0xFF << 48 | 9 << 24 | 4) - 2**64
    df = spark.createDataFrame([(v,) for v in (empty, moved, target)], "v long").select(*(c.alias(n) for n, c in bits.slot_flags(F.col("v")).items()))
    assert [tuple(r) for r in df.collect()] == [(False, False, True), (True, False, False), (False, True, False)]
    pages = spark.createDataFrame([((3 << 48) + 5000,), ((3 << 48) + 9000,)], "pid long")
    found = pages.select("pid", bits.inventory_page(F.col("pid"), F.lit(4), F.lit(9000)).alias("at"), bits.pid_text(F.col("pid")).alias("text"))
    found = found.withColumn("back", bits.target_page(F.col("at.pid"), F.col("at.entry"), F.lit(3))).collect()
    assert tuple(found[0]["at"]) == ((4 << 48) + 2, 904) and found[0]["back"] == found[0]["pid"] and found[1]["at"] is None
    assert found[0]["text"] == "(segNr: 3, pageNr: 5000)"
