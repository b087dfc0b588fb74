"""Numeric views of a column and the small min/max fitting job shared by generalize and perturb."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import dtype_of, is_integral, qcol, reject_nested

# Text accepted as a number (pandas.to_numeric / float()): decimal or exponent form, inf, nan.
NUMBER_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Double value of a numeric (or numeric-text) column; NaN and unparseable text become null."""
    if isinstance(dtype, T.NumericType):
        x = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        x = c.cast("double")
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        x = F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))
    else:
        x = F.lit(None).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


@dataclass(frozen=True)
class Range:
    min: float | None
    max: float | None
    count: int


def fit_range(df: DataFrame, column: str, *, strict_text: bool = True) -> Range:
    """One aggregate job: min, max and non-null count of the column as doubles.

    Text that is not a number raises ``ValueError`` (the reference's ``astype(float)``).
    """
    dtype = dtype_of(df, column)
    reject_nested(dtype, column)
    c = qcol(column)
    x = as_double(c, dtype)
    aggs = [F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n")]
    textual = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    if textual and strict_text:
        aggs.append(F.count_if(c.isNotNull() & ~c.rlike(NUMBER_TEXT)).alias("bad"))
    row = df.agg(*aggs).first()
    if textual and strict_text and row["bad"]:
        raise ValueError(f"Column '{column}' holds {row['bad']} value(s) that are not numbers.")
    return Range(row["mn"], row["mx"], row["n"])


def cast_back(x: Column, dtype: T.DataType, rounding: str = "half_even") -> Column:
    """Return a double result in the column's own type; integers are rounded (or truncated)."""
    if is_integral(dtype):
        if rounding == "truncate":
            r = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
        elif rounding == "half_even":
            r = F.rint(x)
        else:
            raise ValueError(f"Unknown rounding '{rounding}'; use 'half_even' or 'truncate'.")
        return r.cast(dtype)
    if isinstance(dtype, (T.FloatType, T.DecimalType)):
        return x.cast(dtype)
    return x
