"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import bits
from corvane.functions import expressions as E
from corvane.operators import algebra, keyed, locks, records
from corvane.plans.positional import numbered
from corvane.session import ensure_checkpoint_dir, scratch_path, table
from corvane.sources import catalog, tuples, u64
from corvane.types import INT64, char

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None, query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _of(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(*columns)


#: The numbers 42, 21 and 100 of the expressions and the pairs of ``values_source`` are those of the tests that this library is held to.
# sources and sinks ---------------------------------------------------------
_add("scan_region", "SELECT * FROM region", lambda s, d: table(s, d, "region"))
_add(
    "values_source",
    "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 2)) t(c0, c1)",
    lambda s, d: tuples.tuples(s, [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 2)], [INT64, INT64]),
)
_add(
    "print_csv",
    "SELECT n_nationkey || ',' || rpad(n_name, 16, ' ') AS line FROM nation",
    lambda s, d: algebra.print_lines(table(s, d, "nation").select("n_nationkey", char(F.col("n_name")).alias("n_name"))),
)

# projection ----------------------------------------------------------------
_orders = _of("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
_add("project_subset", "SELECT o_custkey FROM orders", lambda s, d: algebra.projection(_orders(s, d), [1]))
_add("project_reorder", "SELECT o_orderpriority, o_orderkey FROM orders", lambda s, d: algebra.projection(_orders(s, d), [3, 0]))
_add("project_repeat", "SELECT o_custkey, o_custkey AS o_custkey_1 FROM orders", lambda s, d: algebra.projection(_orders(s, d), [1, 1]))

# selection -----------------------------------------------------------------
SQL_SIGN = {"EQ": "=", "NE": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}
_customers = _of("customer", "c_custkey", "c_mktsegment")
_lines = _of("lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
for _op, _sign in SQL_SIGN.items():
    _low = _op.lower()
    _add(
        f"select_int_{_low}",
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey {_sign} 70",
        lambda s, d, op=_op: algebra.select_int(_orders(s, d), 1, op, 70),
    )
    _add(
        f"select_char_{_low}",
        f"SELECT c_custkey, c_mktsegment FROM customer WHERE rpad(c_mktsegment, 16, ' ') {_sign} rpad('FURNITURE', 16, ' ')",
        lambda s, d, op=_op: algebra.select_char(_customers(s, d), 1, op, "FURNITURE"),
    )
    _add(
        f"select_attr_{_low}",
        f"SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey {_sign} l_linenumber",
        lambda s, d, op=_op: algebra.select_attributes(_lines(s, d), 1, 2, op),
    )
_add(
    "select_conjunction",
    "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey >= 3 AND l_linenumber < 4 AND l_suppkey <> l_linenumber",
    lambda s, d: algebra.select_attributes(algebra.select_int(algebra.select_int(_lines(s, d), 1, "GE", 3), 2, "LT", 4), 1, 2, "NE"),
)
_add("select_kinds_differ", "SELECT c_custkey, c_mktsegment FROM customer WHERE false", lambda s, d: algebra.select_attributes(_customers(s, d), 0, 1, "EQ"))


# sorting -------------------------------------------------------------------
def _placed(ordered: DataFrame) -> DataFrame:
    """The sorted rows with the places that the sort itself gave them."""
    ensure_checkpoint_dir(ordered.sparkSession)
    return algebra.placed(ordered)


def _sort_multi(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return _placed(algebra.sort(df, [(2, True), (1, False)], ["l_orderkey"]))


_add(
    "sort_multi",
    """SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (ORDER BY l_suppkey DESC, l_linenumber, l_orderkey) AS place FROM lineitem""",
    _sort_multi,
)
_add(
    "sort_desc_stable",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders""",
    lambda s, d: _placed(algebra.sort(_orders(s, d), [(3, True)], ["o_orderkey"])),
)


def _u64_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(u64.as_unsigned(F.shiftleft("l_orderkey", 48) + F.col("l_partkey")).alias("value"))


def _u64_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Sorted values, written to files and read back, in the files' order."""
    u64.register(s)
    path = scratch_path(s, "u64")
    u64.external_sort(_u64_values(s, d)).write.format("u64").mode("overwrite").save(path)
    return _placed(s.read.format("u64").load(path))


_SORTED_U64 = """SELECT value, row_number() OVER (ORDER BY value) AS place
    FROM (SELECT ((l_orderkey % 65536)::HUGEINT * 281474976710656 + l_partkey)::DECIMAL(20, 0) AS value FROM lineitem)"""
_add("external_sort", _SORTED_U64, lambda s, d: _placed(u64.external_sort(_u64_values(s, d))))
_add("u64_round_trip", _SORTED_U64, _u64_round_trip)
_add("u64_descending", "SELECT (1000 - range)::DECIMAL(20, 0) AS value FROM range(1000)", lambda s, d: u64.descending(s, 1000))

# joins ---------------------------------------------------------------------
_JOINED = "c_custkey, c_mktsegment, o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
_add("hash_join_pk_fk", f"SELECT {_JOINED} FROM customer JOIN orders ON c_custkey = o_custkey", lambda s, d: algebra.hash_join(_customers(s, d), _orders(s, d), 0, 1))
_add(
    "hash_join_dup_build",
    "SELECT s_suppkey, s_nationkey, c_custkey, c_nationkey FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    lambda s, d: algebra.hash_join_dup(_of("supplier", "s_suppkey", "s_nationkey")(s, d), _of("customer", "c_custkey", "c_nationkey")(s, d), 1, 1),
)


def _join_chain(s: SparkSession, d: str) -> DataFrame:
    nations = algebra.hash_join(table(s, d, "region"), table(s, d, "nation"), 0, 2)
    return algebra.hash_join(nations, _of("customer", "c_custkey", "c_nationkey")(s, d), 2, 1)


_add(
    "join_chain",
    """SELECT r_regionkey, r_name, n_nationkey, n_name, n_regionkey, c_custkey, c_nationkey
       FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey""",
    _join_chain,
)

# aggregation ---------------------------------------------------------------
_counted = _of("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
_add(
    "agg_keyless",
    "SELECT min(l_suppkey) AS least, max(l_suppkey) AS most, sum(l_linenumber)::BIGINT AS total, count(*) AS n FROM lineitem",
    lambda s, d: algebra.hash_aggregate(_counted(s, d), [], [("MIN", 2, "least"), ("MAX", 2, "most"), ("SUM", 1, "total"), ("COUNT", 0, "n")]),
)
_add(
    "agg_keyless_empty",
    "SELECT max(l_suppkey) AS most, count(*) AS n FROM lineitem WHERE l_suppkey < 0 HAVING count(*) > 0",
    lambda s, d: algebra.hash_aggregate(algebra.select_int(_counted(s, d), 2, "LT", 0), [], [("MAX", 2, "most"), ("COUNT", 0, "n")]),
)
_add(
    "agg_min_max_char",
    "SELECT c_nationkey, min(c_name) AS least, max(c_mktsegment) AS most FROM customer GROUP BY c_nationkey",
    lambda s, d: algebra.hash_aggregate(_of("customer", "c_nationkey", "c_name", "c_mktsegment")(s, d), [0], [("MIN", 1, "least"), ("MAX", 2, "most")]),
)
_add(
    "agg_sum_count",
    "SELECT l_orderkey, sum(l_suppkey)::BIGINT AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    lambda s, d: algebra.hash_aggregate(_counted(s, d), [0], [("SUM", 2, "total"), ("COUNT", 0, "n")]),
)
_add(
    "agg_multi_key",
    "SELECT l_returnflag, l_linenumber, max(l_suppkey) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber",
    lambda s, d: algebra.hash_aggregate(_counted(s, d), [3, 1], [("MAX", 2, "most"), ("COUNT", 0, "n")]),
)
_add("agg_no_funcs", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem", lambda s, d: algebra.hash_aggregate(_counted(s, d), [3, 1], []))

# set operations ------------------------------------------------------------
_SETS = {
    "union": (algebra.union, "UNION"), "union_all": (algebra.union_all, "UNION ALL"), "intersect": (algebra.intersect, "INTERSECT"),
    "intersect_all": (algebra.intersect_all, "INTERSECT ALL"), "except": (algebra.except_, "EXCEPT"), "except_all": (algebra.except_all, "EXCEPT ALL"),
}
for _name, (_function, _word) in _SETS.items():
    _add(
        _name,
        f"SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_nationkey < 15 {_word} SELECT s_nationkey::BIGINT AS k FROM supplier WHERE s_nationkey > 4",
        lambda s, d, f=_function: f(
            table(s, d, "customer").filter("c_nationkey < 15").select(F.col("c_nationkey").cast("long").alias("k")),
            table(s, d, "supplier").filter("s_nationkey > 4").select(F.col("s_nationkey").cast("long").alias("k")),
        ),
    )


# scalar expressions --------------------------------------------------------
def _integers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey")


def _reals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", "l_extendedprice", "l_discount")


def _value(relation, expression: E.Expression):
    return lambda s, d: E.evaluate(relation(s, d), expression, "v").select("l_orderkey", "l_linenumber", "v")


_a, _b = E.argument(2), E.argument(3)
_x, _y, _z = (E.argument(i, E.REAL) for i in (2, 3, 4))
_KEYS = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"
for _name, _expr, _sql in (
    ("add", _a + _b, "l_partkey + l_suppkey"), ("sub", _a - _b, "l_partkey - l_suppkey"), ("mul", _a * _b, "l_partkey * l_suppkey"),
    ("div", (E.integer(0) - _a) / E.argument(1), "-l_partkey // l_linenumber"),
):
    _add(f"expr_{_name}_i64", f"SELECT {_KEYS}, ({_sql})::BIGINT AS v FROM lineitem", _value(_integers, _expr))
for _name, _expr, _sql in (
    ("add", _x + _y, "l_quantity + l_extendedprice"), ("sub", _x - _y, "l_quantity - l_extendedprice"), ("mul", _x * _y, "l_quantity * l_extendedprice"),
    ("div", _x / _y, "l_quantity / l_extendedprice"),
):
    _add(f"expr_{_name}_f64", f"SELECT {_KEYS}, {_sql} AS v FROM lineitem", _value(_reals, _expr))
_add(
    "expr_div_zero_f64",
    f"""SELECT {_KEYS}, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount
        WHEN l_quantity > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS v FROM lineitem""",
    lambda s, d: _div_zero(s, d),
)


def _div_zero(s: SparkSession, d: str) -> DataFrame:
    """IEEE quotients; where the divisor is zero or null the SQL looks at the dividend alone, and a sign or null of it gives NaN."""
    found = E.evaluate(_reals(s, d), _x / _z, "v")
    endless = F.when(F.col("l_quantity") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return found.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") != 0, F.col("v")).otherwise(endless).alias("v"))


_WIDE_A, _WIDE_B = "((l_orderkey % 65536) * 140737488355328 + l_partkey)", "((l_partkey % 32768) * 281474976710656 - l_suppkey)"


def _wide(s: SparkSession, d: str) -> DataFrame:
    high = lambda c, m, p: F.shiftleft(F.col(c) % m, p)
    return table(s, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (high("l_orderkey", 65536, 47) + F.col("l_partkey")).alias("a"),
        (high("l_partkey", 32768, 48) - F.col("l_suppkey")).alias("b"),
    )


def _wrapped_sql(sql: str) -> str:
    power = "18446744073709551616::HUGEINT"
    inside = f"((({sql}) % {power} + {power}) % {power})"
    return f"SELECT {_KEYS}, (CASE WHEN {inside} >= 9223372036854775808::HUGEINT THEN {inside} - {power} ELSE {inside} END)::BIGINT AS v FROM lineitem"


for _name, _expr, _sign in (("add", _a + _b, "+"), ("sub", _a - _b, "-"), ("mul", _a * _b, "*")):
    _wide_expr = (_expr + _a) if _name == "add" else _expr
    _tail = f" + {_WIDE_A}::HUGEINT" if _name == "add" else ""
    _add(f"expr_wrap_{_name}", _wrapped_sql(f"{_WIDE_A}::HUGEINT {_sign} {_WIDE_B}::HUGEINT{_tail}"), _value(_wide, _wide_expr))
_add("cast_i64_f64", f"SELECT {_KEYS}, {_WIDE_A}::DOUBLE AS v FROM lineitem", _value(_wide, E.cast(_a, E.REAL)))
_add("cast_f64_i64", f"SELECT {_KEYS}, trunc(-l_extendedprice)::BIGINT AS v FROM lineitem", _value(_reals, E.cast(E.real(0) - _y, E.LONG)))
_add(
    "expr_cast_mix",
    f"SELECT {_KEYS}, (trunc((42.0::DOUBLE + l_quantity) - (21.0::DOUBLE - l_extendedprice))::BIGINT + l_linenumber + 100)::BIGINT AS v FROM lineitem",
    _value(_reals, E.cast((E.real(42) + _x) - (E.real(21) - _y), E.LONG) + E.argument(1) + E.integer(100)),
)
_add(
    "expr_complex_i64",
    f"SELECT {_KEYS}, (((42 + l_suppkey) * (21 - l_linenumber) * l_partkey + 100) // l_linenumber)::BIGINT AS v FROM lineitem",
    _value(_integers, ((E.integer(42) + _b) * (E.integer(21) - E.argument(1)) * _a + E.integer(100)) / E.argument(1)),
)
CHAIN = 1000


def _chain() -> E.Expression:
    """A left-deep expression of ``CHAIN`` operations."""
    value = E.argument(2)
    for i in range(1, CHAIN + 1):
        value = value + E.argument(3) if i % 3 == 1 else value - E.argument(1) if i % 3 == 2 else value * E.integer(31)
    return value


_POWER = "18446744073709551616::HUGEINT"
_add(
    "expr_chain_i64",
    f"""SELECT {_KEYS}, (CASE WHEN w >= 9223372036854775808::HUGEINT THEN w - {_POWER} ELSE w END)::BIGINT AS v FROM (
        SELECT l_orderkey, l_linenumber, list_reduce(list_prepend(l_partkey::HUGEINT, range(1, {CHAIN + 1})::HUGEINT[]), lambda w, i:
            ((CASE i % 3 WHEN 1 THEN w + l_suppkey WHEN 2 THEN w - l_linenumber ELSE w * 31 END) % {_POWER} + {_POWER}) % {_POWER}) AS w FROM lineitem)""",
    _value(_integers, _chain()),
)
_add("cast_same", f"SELECT {_KEYS}, l_partkey::BIGINT AS v FROM lineitem", _value(_integers, E.cast(_a, E.LONG)))
_add(
    "expr_complex_f64",
    f"SELECT {_KEYS}, (((42.0::DOUBLE + l_extendedprice) - (21.0::DOUBLE - l_quantity)) + l_discount) + 100.0::DOUBLE AS v FROM lineitem",
    _value(_reals, ((E.real(42) + _y) - (E.real(21) - _x)) + _z + E.real(100)),
)


# bit fields ----------------------------------------------------------------
def _pages(s: SparkSession, d: str) -> DataFrame:
    pid = bits.page_number(F.col("l_linenumber"), F.col("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pid.alias("pid"))


_add(
    "pid_split",
    """SELECT l_linenumber::BIGINT * 281474976710656 + l_orderkey AS pid, l_linenumber::BIGINT AS segment, l_orderkey AS page FROM lineitem""",
    lambda s, d: _pages(s, d).select("pid", bits.segment_of(F.col("pid")).alias("segment"), bits.page_in_segment(F.col("pid")).alias("page")),
)
_TID = "xor(l_orderkey << 16, l_linenumber::BIGINT)"
_add(
    "tid_pack",
    f"SELECT l_orderkey, l_linenumber, {_TID} AS tid FROM lineitem",
    lambda s, d: _pages(s, d).select("l_orderkey", "l_linenumber", bits.tid(F.col("l_orderkey"), F.col("l_linenumber")).alias("tid")),
)
_add(
    "tid_unpack",
    f"SELECT {_TID} AS tid, l_orderkey AS page, l_linenumber AS slot, 7 * 281474976710656 + l_orderkey AS pid FROM lineitem",
    lambda s, d: _pages(s, d).select(bits.tid(F.col("l_orderkey"), F.col("l_linenumber")).alias("tid")).select(
        "tid", bits.tid_page(F.col("tid")).alias("page"), bits.tid_slot(F.col("tid")).alias("slot"), bits.tid_page_number(F.col("tid"), F.lit(7)).alias("pid")
    ),
)
_add(
    "slot_fields",
    "SELECT l_linenumber::BIGINT AS t, 3::BIGINT AS s, l_suppkey % 16777216 AS \"offset\", l_partkey % 16777216 AS size FROM lineitem",
    lambda s, d: _pages(s, d).select(bits.slot(F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber"), 3).alias("v")).select(
        *(c.alias(n) for n, c in bits.slot_fields(F.col("v")).items())
    ),
)
#: Least free bytes of the 16 classes of a page of 1024 bytes.
_FLOORS = [0, 7, 15, 31, 63, 126, 253, 506, 571, 634, 697, 760, 823, 886, 949, 1012]
_LADDER = "CASE " + " ".join(f"WHEN {{0}} >= {floor} THEN {n}" for n, floor in reversed(list(enumerate(_FLOORS)))) + " END"
_FLOOR_OF = "CASE {0} " + " ".join(f"WHEN {n} THEN {floor}" for n, floor in enumerate(_FLOORS)) + " END"
_add(
    "fsi_encode",
    f"SELECT l_partkey, {_LADDER.format('(l_partkey % 1024)')} AS class FROM lineitem",
    lambda s, d: _pages(s, d).select("l_partkey", bits.encode_free_space(F.col("l_partkey") % 1024).alias("class")),
)
_add(
    "fsi_decode",
    f"SELECT l_partkey, {_FLOOR_OF.format('(l_partkey % 16)')} AS floor FROM lineitem",
    lambda s, d: _pages(s, d).select("l_partkey", bits.decode_free_space(F.col("l_partkey") % 16).alias("floor")),
)
_add(
    "fsi_locate",
    "SELECT l_orderkey, l_orderkey // 2048 AS page, l_orderkey % 2048 AS entry FROM lineitem",
    lambda s, d: _pages(s, d).select("l_orderkey", *(c.alias(n) for c, n in zip(bits.inventory_place(F.col("l_orderkey")), ("page", "entry"), strict=True))),
)
_add(
    "pid_text",
    "SELECT l_linenumber::BIGINT * 281474976710656 + l_orderkey AS pid, '(segNr: ' || l_linenumber || ', pageNr: ' || l_orderkey || ')' AS text FROM lineitem",
    lambda s, d: _pages(s, d).select("pid", bits.pid_text(F.col("pid")).alias("text")),
)


def _slots(s: SparkSession, d: str) -> DataFrame:
    """Slots of three kinds: empty ones, such that hold another address, and such with a record (moved there if the line number is even)."""
    own = bits.slot(F.col("l_suppkey"), F.col("l_partkey"), 0xFF, F.when(F.col("l_linenumber") % 2 == 0, 0xFF).otherwise(0))
    empty, moved = F.lit(-(1 << 56)).cast("long"), bits.tid(F.col("l_orderkey"), F.col("l_linenumber"))
    return _pages(s, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, empty).when(F.col("l_partkey") % 3 == 1, moved).otherwise(own).alias("v"))


_add(
    "slot_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey % 3 = 1 AS redirect, (l_partkey % 3 = 1 AND (l_orderkey >> 32) % 256 <> 0) OR (l_partkey % 3 = 2 AND l_linenumber % 2 = 0)
       AS redirected_to, l_partkey % 3 = 0 AS empty FROM lineitem""",
    lambda s, d: _slots(s, d).select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in bits.slot_flags(F.col("v")).items())),
)


def _target_pages(s: SparkSession, d: str) -> DataFrame:
    """Each page's inventory page, if there is one, and back."""
    at = bits.inventory_page(F.col("pid"), F.lit(9), F.lit(4000))
    found = _pages(s, d).select("pid", F.col("l_linenumber").alias("segment"), at.alias("at")).filter("at is not null")
    return found.select("pid", F.col("at.pid").alias("inventory"), "at.entry", bits.target_page(F.col("at.pid"), F.col("at.entry"), F.col("segment")).alias("target"))


_add(
    "fsi_target",
    """SELECT l_linenumber::BIGINT * 281474976710656 + l_orderkey AS pid, 9 * 281474976710656 + l_orderkey // 2048 AS inventory, l_orderkey % 2048 AS entry,
       l_linenumber::BIGINT * 281474976710656 + l_orderkey AS target FROM lineitem WHERE l_orderkey < 4000""",
    _target_pages,
)
_DUMPED = r"""SELECT {0}, lpad(upper(to_hex(i)), 4, '0') || ' : ' || rpad(regexp_replace(substr({1}, i + 1, 16), '[^\x20-\x7F]', '.', 'g'), 16, ' ') || ' ' ||
          regexp_replace(hex(substr({1}, i + 1, 16)), '(..)', '\1 ', 'g') AS line
        FROM (SELECT {0}, {1}, unnest(range(0, length({1}), 16)) AS i FROM {2})"""


def _dump(name: str, key: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name).select(key, F.explode(bits.hex_dump(F.col(text).cast("binary"))).alias("line"))


_add("hex_dump", _DUMPED.format("n_nationkey", "n_name", "nation"), _dump("nation", "n_nationkey", "n_name"))
_add("hex_dump_lines", _DUMPED.format("p_partkey", "p_name", "part"), _dump("part", "p_partkey", "p_name"))

# keyed access --------------------------------------------------------------
_map = _of("orders", "o_orderkey", "o_custkey")
_add("btree_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7", lambda s, d: keyed.lookup(_map(s, d), "o_orderkey", 7))
_add("btree_lookup_miss", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = -7", lambda s, d: keyed.lookup(_map(s, d), "o_orderkey", -7))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "lineitem").filter("l_suppkey % 3 = 0").select(
        (F.col("l_orderkey") * 2).alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"), F.col("l_linenumber").alias("seq")
    )
    once = changes.groupBy("o_orderkey", "seq").agg(F.max("o_custkey").alias("o_custkey"))
    return keyed.upsert(_map(s, d), once, "o_orderkey", "seq")


_add(
    "btree_upsert",
    """WITH once AS (SELECT l_orderkey * 2 AS k, l_linenumber AS seq, max(l_partkey) AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY ALL),
            latest AS (SELECT k, arg_max(v, seq) AS v FROM once GROUP BY k)
       SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NULL THEN o_custkey ELSE v END AS o_custkey
       FROM orders FULL JOIN latest ON o_orderkey = k""",
    _upsert,
)
_add(
    "btree_erase",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 5 = 0)",
    lambda s, d: keyed.erase(_map(s, d), table(s, d, "lineitem").filter("l_suppkey % 5 = 0").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"),
)


def _records(s: SparkSession, d: str) -> DataFrame:
    tid = bits.tid(F.expr("p_partkey div 16"), F.col("p_partkey") % 16)
    return table(s, d, "part").select(tid.alias("tid"), F.col("p_name").cast("binary").alias("payload"))


_PART_TID = "xor((p_partkey // 16) << 16, p_partkey % 16)"
_add(
    "tid_read",
    f"SELECT {_PART_TID} AS tid, hex(p_name) AS payload FROM part WHERE p_partkey = 37",
    lambda s, d: records.read(_records(s, d), (37 // 16 << 16) ^ (37 % 16)).select("tid", F.hex("payload").alias("payload")),
)


def _resize(s: SparkSession, d: str) -> DataFrame:
    sizes = _records(s, d).filter("tid % 2 = 0").select("tid", (F.col("tid") % 40).cast("int").alias("size"))
    return records.resize(_records(s, d), sizes).select("tid", F.hex("payload").alias("payload"))


_add(
    "record_resize",
    f"""SELECT tid, CASE WHEN tid % 2 = 0 THEN rpad(left(hex(p_name), 2 * (tid % 40)::INT), 2 * (tid % 40)::INT, '0') ELSE hex(p_name) END AS payload
        FROM (SELECT {_PART_TID} AS tid, p_name FROM part)""",
    _resize,
)
_add(
    "record_erase",
    f"SELECT {_PART_TID} AS tid, hex(p_name) AS payload FROM part WHERE p_size <= 25",
    lambda s, d: records.erase(
        _records(s, d), table(s, d, "part").filter("p_size > 25").select(bits.tid(F.expr("p_partkey div 16"), F.col("p_partkey") % 16).alias("tid"))
    ).select("tid", F.hex("payload").alias("payload")),
)


def _record_write(s: SparkSession, d: str) -> DataFrame:
    changes = _records(s, d).filter("tid % 3 = 0").select((F.col("tid") * 2).alias("tid"), F.lit("changed").cast("binary").alias("payload"), F.lit(1).alias("seq"))
    return records.write(_records(s, d), changes, "seq").select("tid", F.hex("payload").alias("payload"))


_add(
    "record_write",
    f"""WITH r AS (SELECT {_PART_TID} AS tid, p_name FROM part)
        SELECT r.tid, CASE WHEN c.tid IS NULL THEN hex(p_name) ELSE hex('changed') END AS payload
        FROM r LEFT JOIN (SELECT 2 * tid AS tid FROM r WHERE tid % 3 = 0) c ON r.tid = c.tid""",
    _record_write,
)
_FREE = f"""WITH p AS (SELECT p_partkey // 16 AS page, greatest(1012 - (sum(strlen(p_name)) + 8 * count(*))::BIGINT, 0) AS free FROM part GROUP BY 1),
    c AS (SELECT page, free, {_LADDER.format('free')} AS class FROM p)"""
_add("fsi_update", _FREE + " SELECT page, 1012 - free AS used, free, class FROM c", lambda s, d: records.free_space(_records(s, d)))
_add(
    "fsi_find",
    _FREE + f" SELECT min(page) AS page FROM c WHERE {_FLOOR_OF.format('class')} >= 500 HAVING count(*) > 0",
    lambda s, d: records.find_page(records.free_space(_records(s, d)), 500),
)
_add(
    "insert_padded",
    "SELECT n_nationkey, rpad(n_name, 25, ' ') AS n_name, n_regionkey, rpad('a comment on ' || n_name, 152, ' ') AS n_comment FROM nation",
    lambda s, d: catalog.typed_rows(
        table(s, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), F.concat(F.lit("a comment on "), "n_name")),
        catalog.LIGHT_RETAIL.tables["nation"],
    ),
)
_CATALOG = ", ".join(f"('{t.id}', {i}, '{c.id}', '{c.kind}', {c.length}, {c.id in t.primary_key})" for t in catalog.LIGHT_RETAIL.tables.values() for i, c in enumerate(t.columns))
_add(
    "catalog_columns",
    f"SELECT * FROM (VALUES {_CATALOG}) t(table_id, position, column_id, kind, length, in_key)",
    lambda s, d: catalog.Schema.from_json(catalog.LIGHT_RETAIL.to_json()).describe(s),
)


def _database(s: SparkSession, d: str) -> catalog.Database:
    """A stored catalog, opened anew, whose nations are one insert, in the order of their keys."""
    root = scratch_path(s, "catalog")
    catalog.Database(s, root).load_new_schema(catalog.LIGHT_RETAIL)
    db = catalog.Database(s, root)
    db.load_schema()
    nations = table(s, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), F.lit("none").alias("c"))
    db.insert("nation", nations.repartitionByRange(1, nations["n_nationkey"].cast("int")).sortWithinPartitions(F.col("n_nationkey").cast("int")))
    return db


_add("catalog_store", f"SELECT * FROM (VALUES {_CATALOG}) t(table_id, position, column_id, kind, length, in_key)", lambda s, d: _database(s, d).schema.describe(s))
_add(
    "record_allocate",
    """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS tid, n_nationkey, rpad(n_name, 25, ' ') AS n_name, n_regionkey, rpad('none', 152, ' ') AS n_comment FROM nation
       UNION ALL SELECT 281474976710656, 99, rpad('Atlantis', 25, ' '), 9, rpad('', 152, ' ')""",
    lambda s, d: _allocated(s, d),
)


def _allocated(s: SparkSession, d: str) -> DataFrame:
    """All records by the addresses that two inserts gave back."""
    db = _database(s, d)
    given = db.table("nation").select("tid")
    more = db.insert("nation", s.createDataFrame([("99", "Atlantis", "9", "")], "a string, b string, c string, d string").coalesce(1))
    return db.table("nation").join(given.union(more).distinct(), "tid")


_add(
    "tuple_line",
    "SELECT n_nationkey || ' | ' || rpad(n_name, 25, ' ') || ' | ' || n_regionkey || ' | ' || rpad('none', 152, ' ') AS line FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 7",
    lambda s, d: _database(s, d).read_tuple("nation", 7),
)


# logs of locks and page accesses --------------------------------------------
def _held(s: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 7 == 0, F.lit("Exclusive")).otherwise(F.lit("Shared"))
    return table(s, d, "events").filter("event_id % 2 = 0").select((F.col("event_id") % 997).alias("item"), F.col("user_id").alias("txn"), mode.alias("mode"))


def _requested(s: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 3 == 0, F.lit("Exclusive")).otherwise(F.lit("Shared"))
    return table(s, d, "events").filter("event_id % 2 = 1").select((F.col("event_id") % 997).alias("item"), F.col("user_id").alias("txn"), mode.alias("mode"))


_HELD = "SELECT event_id % 997 AS item, user_id AS txn, CASE WHEN event_id % 7 = 0 THEN 'Exclusive' ELSE 'Shared' END AS mode FROM events WHERE event_id % 2 = 0"
_WANTED = "SELECT event_id % 997 AS item, user_id AS txn, CASE WHEN event_id % 3 = 0 THEN 'Exclusive' ELSE 'Shared' END AS mode FROM events WHERE event_id % 2 = 1"
_EDGES = f"""SELECT DISTINCT w.txn AS waiter, h.txn AS owner FROM ({_WANTED}) w JOIN ({_HELD}) h ON w.item = h.item
             WHERE w.txn <> h.txn AND NOT (w.mode = 'Shared' AND h.mode = 'Shared')"""
_add("lock_mode", f"SELECT item, min(mode) AS mode, count(DISTINCT txn) AS holders FROM ({_HELD}) GROUP BY item", lambda s, d: locks.lock_modes(_held(s, d)))
_add("waits_for_edges", _EDGES, lambda s, d: locks.waits_for(_requested(s, d), _held(s, d)))
_add(
    "waits_for_without",
    f"WITH e AS ({_EDGES}) SELECT waiter, owner FROM e WHERE waiter % 4 <> 0 AND owner % 4 <> 0",
    lambda s, d: locks.waits_for_without(_requested(s, d), _held(s, d), _held(s, d).filter("txn % 4 = 0").union(_requested(s, d).filter("txn % 4 = 0"))),
)


def _ring(s: SparkSession, d: str) -> DataFrame:
    """Customers that wait for the next of their nation; every third nation's ring is closed."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("waiter"), F.col("c_nationkey").alias("nation"))
    order = W.partitionBy("nation").orderBy("waiter")
    first = F.when(F.col("nation") % 3 == 0, F.first("waiter").over(order))
    return c.withColumn("owner", F.coalesce(F.lead("waiter").over(order), first)).filter("owner is not null and owner <> waiter").select("waiter", "owner")


def _deadlocked(s: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(s)
    return locks.deadlocked(_ring(s, d))


_add(
    "deadlock_cycles",
    """SELECT c_custkey AS txn FROM customer WHERE c_nationkey % 3 = 0
       AND c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1)""",
    _deadlocked,
)
_add(
    "cache_queues",
    """SELECT user_id % 8 AS pool, event_id % 61 AS page, CASE WHEN count(*) > 1 THEN 'lru' ELSE 'fifo' END AS queue,
              max(event_id) AS "at", count(*) AS uses FROM events GROUP BY 1, 2""",
    lambda s, d: locks.cache_queues(table(s, d, "events").select((F.col("user_id") % 8).alias("pool"), F.col("event_id").alias("seq"), (F.col("event_id") % 61).alias("page"))),
)


# the flagship ----------------------------------------------------------------
def segment_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders of one market segment's customers, by priority: filter, join, aggregate, sort."""
    building = algebra.select_char(_customers(s, d), 1, "EQ", "BUILDING")
    joined = algebra.hash_join(building, _orders(s, d), 0, 1)
    grouped = algebra.hash_aggregate(joined, [5], [("COUNT", 0, "n"), ("SUM", 0, "total"), ("MIN", 2, "first_order")])
    return algebra.sort(grouped, [(0, False)])


_add(
    "segment_orders",
    """SELECT o_orderpriority, count(*) AS n, sum(c_custkey)::BIGINT AS total, min(o_orderkey) AS first_order
       FROM customer JOIN orders ON c_custkey = o_custkey WHERE rpad(c_mktsegment, 16, ' ') = rpad('BUILDING', 16, ' ') GROUP BY o_orderpriority ORDER BY 1""",
    segment_orders,
)
_add("positional_names", "SELECT r_regionkey AS c0, r_name AS c1 FROM region", lambda s, d: numbered(table(s, d, "region")))
