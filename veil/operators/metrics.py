"""Precision / privacy trade-off: weighted share of cells left unchanged.

Works on the paired frame (working columns plus ``__orig_<c>`` for changed ones), so it is one
aggregate with no join. Semantics kept from the reference: sensitive columns weigh 2, others 1;
null never equals null; cells of a number and a text never compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import family, local_frame, nan_to_null, orig_name, qcol
from ..metadata import Metadata
from .positions import with_position


def equal_count(c: str, changed: bool, orig_type: T.DataType, work_type: T.DataType) -> Column:
    if not changed:
        return F.count(qcol(c))
    if family(orig_type) != family(work_type):
        return F.count(F.lit(None))  # never equal: 0
    return F.count_if(qcol(orig_name(c)) == qcol(c))


def precision_privacy(frame: DataFrame, columns: list[str], changed: set[str], metadata: Metadata,
                      rows: int | None = None) -> DataFrame:
    """One-row DataFrame ``(precision_pct, privacy_pct)``; zero cells give (100, 0).

    ``rows``: the expected row count; the query fails if the frame has another (a join on a key
    that is not unique), checked inside the same aggregate.
    """
    return _from_counts(frame.agg(*_counts(frame, columns, changed)), columns, metadata, rows)


def observed_precision(frame: DataFrame, columns: list[str], changed: set[str], metadata: Metadata
                       ) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``frame`` that counts its cells in the next action on it, and a function that gives the metric afterwards."""
    seen = Observation()
    aggs = _counts(frame, columns, changed)
    names = ["__n", *(f"__eq{i}" for i in range(len(columns)))]

    def finish() -> DataFrame:
        got = seen.get
        row = local_frame(frame.sparkSession, [tuple(int(got[n]) for n in names)],
                          T.StructType([T.StructField(n, T.LongType()) for n in names]))
        return _from_counts(row, columns, metadata)

    return frame.observe(seen, *aggs), finish


def _counts(frame: DataFrame, columns: list[str], changed: set[str]) -> list[Column]:
    """Rows, and each column's unchanged cells."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        o = types[orig_name(c)] if c in changed else types[c]
        aggs.append(equal_count(c, c in changed, o, types[c]).alias(f"__eq{i}"))
    return aggs


def _from_counts(row: DataFrame, columns: list[str], metadata: Metadata, rows: int | None = None) -> DataFrame:
    n = F.col("__n").cast("double")
    total = F.lit(0.0)
    unchanged = F.lit(0.0)
    for i, c in enumerate(columns):
        w = metadata.weight(c)
        total = total + F.lit(w) * n
        unchanged = unchanged + F.lit(w) * F.col(f"__eq{i}").cast("double")
    precision = F.when(total == 0, F.lit(100.0)).otherwise(unchanged / total * F.lit(100.0))
    if rows is not None:
        precision = F.when(F.col("__n") != F.lit(rows),
                           F.raise_error(F.lit("The key does not align the two tables one to one.")).cast("double")
                           ).otherwise(precision)
    return row.select(precision.alias("precision_pct")).select(
        "precision_pct", (F.lit(100.0) - F.col("precision_pct")).alias("privacy_pct")
    )


def precision_privacy_between(original: DataFrame, working: DataFrame, key: list[str],
                              metadata: Metadata) -> DataFrame:
    """The same metric for two separate tables aligned on a unique ``key`` (e.g. a re-read export).

    Row counts and column lists must match, as in the reference; a key that repeats or has no partner
    raises. Keys are counted on each side first (partial counts, so a hot key costs nothing), which
    rules out a join of many with many; then rows meet in an inner join.
    """
    if list(original.columns) != list(working.columns):
        raise ValueError("The two tables differ in columns or row count; cells cannot be paired.")
    n, most = _keys(original, key)
    m, most_working = _keys(working, key)
    if n != m:
        raise ValueError("The two tables differ in columns or row count; cells cannot be paired.")
    if max(most, most_working) > 1:
        raise ValueError("The key repeats; it does not align the two tables one to one.")
    cols = list(original.columns)
    o = original.select(*[qcol(c).alias(orig_name(c)) for c in cols])
    cond = None
    for k in key:
        e = qcol(orig_name(k)).eqNullSafe(qcol(k))
        cond = e if cond is None else cond & e
    paired = o.join(working, cond)
    return precision_privacy(paired, cols, set(cols), metadata, rows=n)


def precision_privacy_by_position(original: DataFrame, working: DataFrame, metadata: Metadata) -> DataFrame:
    """The same metric for two tables read from files, row by row in file order (``positions``).

    Columns must match by name and order and row counts must be equal, as in the reference; NaN is a missing value.
    Positions are unique, so the join has no hot key; the row count is checked again inside the aggregate.
    """
    if list(original.columns) != list(working.columns):
        raise ValueError("The two tables differ in columns or row count; cells cannot be paired.")
    n = original.count()
    if n != working.count():
        raise ValueError("The two tables differ in columns or row count; cells cannot be paired.")
    cols = list(original.columns)
    left, right = (with_position(d, "__position") for d in (original, working))
    o = left.select(*[nan_to_null(qcol(f.name), f.dataType).alias(orig_name(f.name)) for f in original.schema.fields],
                    F.col("__position").alias("__at"))
    w = right.select(*[nan_to_null(qcol(f.name), f.dataType).alias(f.name) for f in working.schema.fields], "__position")
    paired = o.join(w, F.col("__at") == F.col("__position"))
    return precision_privacy(paired, cols, set(cols), metadata, rows=n)


def _keys(df: DataFrame, key: list[str]) -> tuple[int, int]:
    """Rows, and the most rows that share a key."""
    per = df.groupBy(*[qcol(k) for k in key]).agg(F.count(F.lit(1)).alias("__m"))
    r = per.agg(F.coalesce(F.sum("__m"), F.lit(0)), F.coalesce(F.max("__m"), F.lit(0))).first()
    return int(r[0]), int(r[1])
