"""Stringification as native Column expressions.

``py_str`` renders a value the way Python's ``str()`` does, so masking a numeric column gives the
same text as the reference's per-value ``str(value)``. ``key_text`` is an injective text form,
independent of session settings, used as hash input and for exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python prints doubles in fixed notation for 1e-4 <= |x| < 1e16, Java (Spark's cast) only for
# 1e-3 <= |x| < 1e7; both aim at the shortest round-tripping digits. (Java before 19 sometimes
# prints a 17th digit where 16 suffice, so such doubles can differ from Python in that digit.)
_SCI = r"^(-?)(\d)(?:\.(\d+))?E(-?)(\d+)$"


def _double_py_str(c: Column) -> Column:
    s = c.cast("string")
    a = F.abs(c)
    mant_frac = F.regexp_replace(F.regexp_extract(s, _SCI, 3), "0+$", "")
    exp_sign = F.when(F.regexp_extract(s, _SCI, 4) == "-", F.lit("-")).otherwise(F.lit("+"))
    sci = F.concat(
        F.regexp_extract(s, _SCI, 1),
        F.regexp_extract(s, _SCI, 2),
        F.when(mant_frac == "", F.lit("")).otherwise(F.concat(F.lit("."), mant_frac)),
        F.lit("e"),
        exp_sign,
        # at least two exponent digits (lpad would cut a three-digit exponent)
        F.when(F.length(F.regexp_extract(s, _SCI, 5)) < 2, F.concat(F.lit("0"), F.regexp_extract(s, _SCI, 5)))
        .otherwise(F.regexp_extract(s, _SCI, 5)),
    )
    # fixed notation through an exact decimal (Spark converts via the same shortest digits)
    small = F.regexp_replace(c.try_cast("decimal(38,37)").cast("string"), "0+$", "")
    large = F.regexp_replace(
        F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), F.lit("nan"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when(c == 0, s)
        .when((a >= 1e16) | (a < 1e-4), sci)
        .when(a < 1e-3, small)
        .when(a >= 1e7, large)
        .otherwise(s)
    )


def py_str(c: Column, dtype: T.DataType) -> Column:
    """Text of each non-null value as Python's ``str`` would print it; null stays null."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _double_py_str(c.cast("double"))
    return c.cast("string")


def key_text(c: Column, dtype: T.DataType) -> Column:
    """Injective text per type (``-0.0`` folded into ``0.0``), null stays null."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c).cast("double").cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.TimestampType):
        # an instant: its text would depend on the session time zone, its microseconds do not
        return F.unix_micros(c).cast("string")
    return c.cast("string")
