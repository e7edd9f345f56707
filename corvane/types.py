"""Value types of the relational model and their Spark types.

======== ======================= =========================================
name     Spark type              values
======== ======================= =========================================
INT64    LongType                signed 64-bit integers
CHAR16   StringType              16 characters, padded with blanks
DOUBLE   DoubleType              IEEE-754 doubles
U64      DecimalType(20, 0)      unsigned 64-bit integers, in unsigned order
integer  IntegerType             catalog columns of 32 bits
char(n)  StringType              catalog columns, padded or cut to n
======== ======================= =========================================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT64 = T.LongType()
DOUBLE = T.DoubleType()
U64 = T.DecimalType(20, 0)
CHAR16_LENGTH = 16


def char(value: Column, length: int = CHAR16_LENGTH) -> Column:
    """A fixed-width character value: padded with blanks on the right, or cut."""
    return F.rpad(value.cast("string"), length, " ")


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
