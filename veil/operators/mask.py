"""``mask_column``: stringify each non-null value and apply one masking strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from .._util import dtype_of, nan_to_null, qcol, reject_nested
from ..functions import masking, regex
from ..functions.text import py_str


def validate(strategy: str, k: int | None, regex_pattern: str | None,
             spark: SparkSession | None = None) -> str | None:
    """Eager parameter checks; returns the Java form of the regex for ``mask_regex``."""
    if strategy not in masking.STRATEGIES:
        raise ValueError(f"'{strategy}' is not a masking strategy; choose one of {', '.join(masking.STRATEGIES)}.")
    if strategy in ("mask_first_k", "mask_last_k"):
        if k is None or isinstance(k, bool) or not isinstance(k, int) or k < 0:
            raise ValueError("k must be an integer of 0 or more for this strategy.")
    if strategy != "mask_regex":
        return None
    java = regex.to_java(regex.check_python(regex_pattern))
    if spark is not None:
        # compile once in the JVM; the query is constant-folded on the driver, no job runs
        try:
            spark.sql("SELECT regexp_replace('', :p, '*')", args={"p": java}).collect()
        except Exception as e:  # noqa: BLE001 - any JVM pattern error
            raise ValueError(f"Invalid regex pattern for the Spark engine: {e}") from e
    return java


def masked(c: Column, dtype: T.DataType, strategy: str, k: int | None, java_pattern: str | None) -> Column:
    s = py_str(nan_to_null(c, dtype), dtype)
    if strategy == "mask_first_k":
        return masking.mask_first_k(s, k)
    if strategy == "mask_last_k":
        return masking.mask_last_k(s, k)
    if strategy == "mask_before_first_space":
        return masking.mask_before_first_space(s)
    if strategy == "mask_after_last_space":
        return masking.mask_after_last_space(s)
    return masking.mask_regex(s, java_pattern)


def mask(df: DataFrame, column: str, strategy: str, k: int | None = None,
         regex_pattern: str | None = None) -> DataFrame:
    dtype = dtype_of(df, column)
    reject_nested(dtype, column)
    java = validate(strategy, k, regex_pattern, df.sparkSession)
    return df.withColumn(column, masked(qcol(column), dtype, strategy, k, java))
