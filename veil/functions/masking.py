"""Masking strategies as native string expressions (no Python UDF).

Lengths and offsets count code points, as Python does. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strategy names callers pass, as in the reference.
STRATEGIES = (
    "mask_first_k",
    "mask_last_k",
    "mask_before_first_space",
    "mask_after_last_space",
    "mask_regex",
)

_MAX = 2147483647


def _star() -> Column:
    return F.lit("*")


def _clamp(k: int) -> int:
    # Spark strings are shorter than 2^31 characters, so a larger k masks the same as this one
    return min(k, _MAX - 1)


def mask_first_k(s: Column, k: int) -> Column:
    # least() skips nulls: without the guard a null string would ask repeat() for k stars
    n = F.least(F.lit(_clamp(k)), F.length(s))
    return F.when(s.isNotNull(), F.concat(F.repeat(_star(), n), s.substr(n + 1, F.lit(_MAX))))


def mask_last_k(s: Column, k: int) -> Column:
    k = _clamp(k)
    n = F.length(s)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(n <= k, F.repeat(_star(), n))
        # least(k, n) == k here; keeping it data-dependent stops constant folding of repeat('*', k)
        .otherwise(F.concat(s.substr(F.lit(1), n - k), F.repeat(_star(), F.least(F.lit(k), n))))
    )


def mask_before_first_space(s: Column) -> Column:
    i = F.instr(s, " ")
    return F.when(i == 0, s).otherwise(F.concat(F.repeat(_star(), i - 1), s.substr(i, F.lit(_MAX))))


def mask_after_last_space(s: Column) -> Column:
    tail = F.length(F.substring_index(s, " ", -1))
    return (
        F.when(F.instr(s, " ") == 0, s)
        .otherwise(F.concat(s.substr(F.lit(1), F.length(s) - tail), F.repeat(_star(), tail)))
    )


def mask_regex(s: Column, java_pattern: str) -> Column:
    """Every non-overlapping match becomes one ``*``."""
    return F.regexp_replace(s, F.lit(java_pattern), F.lit("*"))
