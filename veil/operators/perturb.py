"""Bounded Gaussian perturbation scaled to the column's range."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import is_hashable, dtype_of, qcol, reject_nested
from ..functions.hashing import secret_value
from ..functions.noise import keyed_standard_normal, row_fingerprint
from ..functions.text import key_text
from .numeric import Range, as_double, cast_back, fit_range


def check_noise(noise_std: float) -> None:
    if noise_std is None or noise_std < 0:
        raise ValueError("noise_std must be a non-negative number.")


def fit_perturb_range(df: DataFrame, column: str) -> Range:
    dtype = dtype_of(df, column)
    reject_nested(dtype, column)
    if not isinstance(dtype, (T.NumericType, T.BooleanType)):
        raise TypeError(f"Column '{column}' of type {dtype.simpleString()} has no numeric range to perturb.")
    r = fit_range(df, column)
    if r.min is not None and (abs(r.min) == float("inf") or abs(r.max) == float("inf")):
        raise ValueError(f"Column '{column}' contains infinity; its range is undefined.")
    return r


def perturbed(c: Column, dtype: T.DataType, r: Range, noise_std: float, z: Column) -> Column:
    """``clip(v + z * noise_std * (max - min), min, max)``; range 0 counts as 1. Nulls stay null."""
    if r.min is None:
        return c
    rng = r.max - r.min
    if rng == 0:
        rng = 1.0
    eff = float(noise_std * rng)
    v = as_double(c, dtype) + z * F.lit(eff)
    # least/greatest skip nulls, so guard them: a null value stays null
    clipped = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(r.min)), F.lit(r.max)))
    return cast_back(clipped, dtype)


def standard_noise(df: DataFrame, column: str, noise_std: float, random_state: int | None,
                   key: list[str]) -> Column:
    """Keyed N(0, 1) per row; a constant 0 when ``noise_std`` is 0 (no hashing needed)."""
    if noise_std == 0:
        return F.lit(0.0)
    if list(key) == list(df.columns):
        keys = row_fingerprint([qcol(k) for k in key if is_hashable(dtype_of(df, k))])
    else:
        keys = [key_text(qcol(k), dtype_of(df, k)) for k in key]
    return keyed_standard_normal(seed_value(df.sparkSession, random_state), column, keys)


def draw_seed(random_state: int | None) -> int:
    return int(random_state) if random_state is not None else secrets.randbits(62)


def seed_value(spark, random_state: int | None) -> Column:
    """The seed (drawn fresh when None) as a scalar subquery, kept out of plan strings."""
    return secret_value(spark, str(draw_seed(random_state)))


def perturb(df: DataFrame, column: str, noise_std: float = 0.05, random_state: int | None = None,
            key: list[str] | None = None) -> DataFrame:
    """Perturb ``column``; noise is a deterministic function of (seed, column, key columns).

    ``key`` defaults to every column of the row. Rows equal in all key columns get equal noise.
    """
    check_noise(noise_std)
    dtype = dtype_of(df, column)
    r = fit_perturb_range(df, column)
    z = standard_noise(df, column, noise_std, random_state, key or df.columns)
    return df.withColumn(column, perturbed(qcol(column), dtype, r, noise_std, z))
