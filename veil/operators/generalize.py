"""Numeric generalization: each value becomes the midpoint of its equal-width bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .._util import dtype_of, qcol, reject_nested
from ..functions import binning
from .numeric import as_double, cast_back, fit_range


def fit_bins(df: DataFrame, column: str, bins: int = 10, include_lowest: bool = True) -> binning.Bins:
    """One aggregate job (min, max, count) and ``bins + 1`` edges computed on the driver."""
    if isinstance(bins, bool) or not isinstance(bins, int) or bins < 1:
        raise ValueError("`bins` should be a positive integer.")
    r = fit_range(df, column)
    if r.count == 0:
        raise ValueError(f"Cannot generalize column '{column}': it has no non-null values.")
    return binning.fit(r.min, r.max, bins, include_lowest)


def generalized(c: Column, dtype: T.DataType, bins: binning.Bins, rounding: str = "half_even",
                clamp: bool = False) -> Column:
    mid = binning.midpoint(as_double(c, dtype), bins, clamp=clamp)
    return cast_back(mid, dtype, rounding)


def generalize(df: DataFrame, column: str, bins: int = 10, include_lowest: bool = True,
               rounding: str = "half_even") -> DataFrame:
    dtype = dtype_of(df, column)
    reject_nested(dtype, column)
    b = fit_bins(df, column, bins, include_lowest)
    return df.withColumn(column, generalized(qcol(column), dtype, b, rounding))
