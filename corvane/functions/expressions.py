"""Typed scalar expressions over integers (wrapping at 64 bits) and doubles.

Operands must be of one kind; casts are explicit.  Sums, differences and
products of integers wrap as two's complement numbers.  ``evaluate`` builds
Spark's own arithmetic under the mode that wraps, while divisions and casts are
built under the mode that the session has; a plan keeps the mode it was built under.
Deep expressions become a row of projections, so that a plan grows in proportion to
the expression.  ``Expression.on`` gives a plain column instead, whose integers go
through exact decimals and wrap under any mode; it is slower.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.positional import at, quoted

LONG, REAL = "long", "double"
DEEPEST = 64  # operations of one projection, one inside the other
ANSI = "spark.sql.ansi.enabled"


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _wrapped(exact: Column) -> Column:
    """The signed 64-bit number that an exact one wraps to."""
    power, half = F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")
    return (F.pmod(exact + half, power) - half).cast(LONG)


def wrapping_add(a: Column, b: Column) -> Column:
    return _wrapped(_wide(a) + _wide(b))


def wrapping_sub(a: Column, b: Column) -> Column:
    return _wrapped(_wide(a) - _wide(b))


def wrapping_mul(a: Column, b: Column) -> Column:
    """Products of 64-bit numbers have 38 digits at most."""
    return _wrapped(_wide(a) * _wide(b))


def _ieee_quotient(a: Column, b: Column) -> Column:
    negative = (a < 0) != (b.cast("string") == "-0.0")
    endless = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(negative, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when((b == 0) & a.isNotNull(), endless).otherwise(a / F.nullif(b, F.lit(0.0)))


def real_divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity, or NaN for 0/0 and NaN/0; a null operand gives null."""
    both = F.array(F.struct(a.alias("a"), b.alias("b")))  # so that each operand comes once
    return F.element_at(F.transform(both, lambda x: _ieee_quotient(x["a"], x["b"])), 1)


@dataclass(frozen=True)
class Expression:
    """A node: ``kind`` is ``long`` or ``double``; ``on(df)`` gives its column."""

    kind: str

    def on(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def __add__(self, other: Expression) -> Expression:
        return Binary.of("+", self, other)

    def __sub__(self, other: Expression) -> Expression:
        return Binary.of("-", self, other)

    def __mul__(self, other: Expression) -> Expression:
        return Binary.of("*", self, other)

    def __truediv__(self, other: Expression) -> Expression:
        return Binary.of("/", self, other)


@dataclass(frozen=True)
class Constant(Expression):
    value: int | float = 0

    def on(self, df: DataFrame) -> Column:
        return F.lit(self.value).cast(self.kind)


@dataclass(frozen=True)
class Argument(Expression):
    index: int = 0

    def on(self, df: DataFrame) -> Column:
        return at(df, self.index).cast(self.kind)


@dataclass(frozen=True)
class Cast(Expression):
    """To double (nearest) or to long (towards zero); the same kind is left alone."""

    child: Expression | None = None

    def on(self, df: DataFrame) -> Column:
        return self.child.on(df) if self.child.kind == self.kind else self.child.on(df).cast(self.kind)


def _int_divide(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


@dataclass(frozen=True)
class Binary(Expression):
    operator: str = "+"
    left: Expression | None = None
    right: Expression | None = None

    INTEGER: ClassVar[dict] = {"+": wrapping_add, "-": wrapping_sub, "*": wrapping_mul, "/": _int_divide}
    REAL_NUMBERS: ClassVar[dict] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": real_divide}

    @classmethod
    def of(cls, operator: str, left: Expression, right: Expression) -> Binary:
        if left.kind != right.kind:
            raise TypeError(f"{left.kind} {operator} {right.kind}: operands must be of one kind")
        return cls(left.kind, operator, left, right)

    def on(self, df: DataFrame) -> Column:
        table = self.INTEGER if self.kind == LONG else self.REAL_NUMBERS
        return table[self.operator](self.left.on(df), self.right.on(df))


def integer(value: int) -> Constant:
    return Constant(LONG, value)


def real(value: float) -> Constant:
    return Constant(REAL, value)


def argument(index: int, kind: str = LONG) -> Argument:
    return Argument(kind, index)


def cast(child: Expression, kind: str) -> Cast:
    return Cast(kind, child)


@contextmanager
def _ansi(spark: SparkSession, on: bool) -> Iterator[None]:
    """Plans that are built inside keep this mode.  The session's setting changes meanwhile: not for several threads at once."""
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, str(on).lower())
    try:
        yield
    finally:
        spark.conf.set(ANSI, before)


@dataclass
class _Value:
    """A column still to be projected: how deep it is, and whether its operations wrap (None: either mode will do)."""

    column: Column
    kind: str
    depth: int = 0
    wraps: bool | None = None


def _apart(column: Column, kind: str) -> Column:
    """The column itself, in a form that keeps the steps before it apart.

    A column that is named twice is not put in the place of its name, which would
    make one deep expression again, and a lambda ends the code generated for
    one stage, so that each step becomes a method that is small enough to be compiled.
    """
    twice = column.bitwiseOR(column) if kind == LONG else F.greatest(column, column)
    return F.element_at(F.transform(F.array(twice), lambda x: x), 1)


class _Projections:
    """A relation to which steps of a value are added, each in a projection of its own mode."""

    def __init__(self, df: DataFrame):
        self.df, self.columns, self.made = df, df.columns, 0

    def project(self, value: _Value, name: str) -> None:
        spark = self.df.sparkSession
        with _ansi(spark, spark.conf.get(ANSI) == "true" and not value.wraps):
            self.df = self.df.withColumn(name, value.column)

    def keep(self, value: _Value) -> _Value:
        """The value as a column of the relation."""
        if not value.depth:
            return value
        self.made += 1
        while (name := f"_step_{self.made}") in self.columns:
            self.made += 1
        self.project(value, name)
        column = F.col(name)
        return _Value(_apart(column, value.kind) if value.depth >= DEEPEST else column, value.kind)

    def binary(self, node: Binary, left: _Value, right: _Value) -> _Value:
        wraps = None
        if node.operator == "/":
            wraps = False
            if node.kind == REAL:
                left, right = self.keep(left), self.keep(right)
        elif node.kind == LONG:
            wraps = True
        left, right = (self.keep(v) if v.depth >= DEEPEST or None not in (v.wraps, wraps) and v.wraps != wraps else v for v in (left, right))
        if None not in (left.wraps, right.wraps) and left.wraps != right.wraps:
            left = self.keep(left)
        modes = [m for m in (wraps, left.wraps, right.wraps) if m is not None]
        plain = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _int_divide if node.kind == LONG else _ieee_quotient}
        return _Value(plain[node.operator](left.column, right.column), node.kind, 1 + max(left.depth, right.depth), modes[0] if modes else None)

    def cast(self, node: Cast, child: _Value) -> _Value:
        if child.kind == node.kind:
            return child
        if node.kind == LONG and child.wraps or child.depth >= DEEPEST:
            child = self.keep(child)
        return _Value(child.column.cast(node.kind), node.kind, child.depth + 1, False if node.kind == LONG else child.wraps)


def evaluate(df: DataFrame, expression: Expression, name: str) -> DataFrame:
    """``df`` with the expression's value as a further column; a column of that name is replaced.

    Division by zero of integers and casts out of range do what the session's mode says.
    """
    steps, waiting, values = _Projections(df), [(expression, False)], []
    while waiting:  # operands first, without recursion
        node, ready = waiting.pop()
        children = [node.left, node.right] if isinstance(node, Binary) else [node.child] if isinstance(node, Cast) else []
        if not children:
            values.append(_Value(node.on(df), node.kind))
        elif not ready:
            waiting += [(node, True), *((c, False) for c in reversed(children))]
        elif isinstance(node, Binary):
            right, left = values.pop(), values.pop()
            values.append(steps.binary(node, left, right))
        else:
            values.append(steps.cast(node, values.pop()))
    steps.project(values.pop(), name)
    return steps.df.select(*(F.col(quoted(c)) for c in dict.fromkeys([*df.columns, name])))
