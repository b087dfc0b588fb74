"""Per-column statistics, exact and distributed.

Cells are unpivoted once into fixed-width keys (numbers as they are, texts as 128 bits of hash, so a
long text travels as 16 bytes) and reduced to distinct keys with their multiplicity (map-side combined: a
hot value costs one row a task), which stay on the executors until the result is known. Counts, exact distinct
counts, mean, min, max and the sample deviation are sums over them; medians come from radix selection
(``selection``), which moves counts only. The rule is the same for any number of values; nothing is sorted
or written to the scratch folder, and no column's values are gathered in one task or on the driver. ``approx=True`` swaps in ``approx_count_distinct`` and
``percentile_approx`` in one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import INTEGRAL, local_frame, qcol
from ..functions.text import key_text
from ..metadata import NUMERIC, Metadata
from .numeric import as_double
from .selection import medians

SCHEMA = T.StructType([
    T.StructField("o", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
])
MEANS = T.StructType([T.StructField("o", T.IntegerType()), T.StructField("mean", T.DoubleType())])
SUMMARY = T.StructType([T.StructField(n, t) for n, t in (
    ("o", T.IntegerType()), ("count", T.LongType()), ("unique_count", T.LongType()), ("nulls", T.LongType()),
    ("mean", T.DoubleType()), ("min", T.DoubleType()), ("max", T.DoubleType()), ("std", T.DoubleType()),
    ("median", T.DoubleType()))])
# approx=True: relative standard deviation of the distinct-count sketch (bounded HyperLogLog++ state)
APPROX_RSD = 0.01

# The statistics columns, in the reference's order.
OUTPUT = ["column", "type", "count", "unique_count", "nulls", "mean", "min", "max", "std", "median"]


def _keys(c, dtype: T.DataType):
    """(k, x, t): the value as an exact long, a double or a text - exactly one carries it."""
    none_l, none_d, none_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, INTEGRAL) or isinstance(dtype, T.BooleanType):
        return c.cast("long"), none_d, none_s
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long"), none_d, none_s
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), none_d, none_s
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return none_l, as_double(c, dtype), none_s
    # text, decimals, binary and local date-times (TIMESTAMP_NTZ): their text is exact, while
    # turning a local date-time into an instant would depend on the session time zone
    return none_l, none_d, key_text(c, dtype)


def _unpivot(df: DataFrame, metadata: Metadata) -> DataFrame:
    """Rows ``(o, k, x, t)``; ``x`` is the number statistics use (declared-numeric columns only).

    Grouping on typed keys avoids turning every number into text; a value is null exactly
    when ``k``, ``x`` and ``t`` are all null.
    """
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        k, x, t = _keys(c, f.dataType)
        numeric = metadata.declared_type(f.name) == NUMERIC
        if numeric and k is not None and not isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            x = as_double(c, f.dataType)
        elif not numeric and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            # a fractional column declared categorical: keep the double only as a grouping key
            k, x, t = F.lit(None).cast("long"), F.lit(None).cast("double"), key_text(c, f.dataType)
        structs.append(F.struct(F.lit(i).alias("o"), k.alias("k"), x.alias("x"), t.alias("t")))
    return df.select(F.inline(F.array(*structs)))


def _columns(df: DataFrame, metadata: Metadata) -> DataFrame:
    rows = [(i, c, metadata.declared_type(c)) for i, c in enumerate(df.columns)]
    return local_frame(df.sparkSession, rows, SCHEMA)


def _finish(df: DataFrame, metadata: Metadata, stats: DataFrame) -> DataFrame:
    out = _columns(df, metadata).join(F.broadcast(stats), "o", "left")
    for c in ("count", "unique_count", "nulls"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out.orderBy("o").select(*OUTPUT)


def column_statistics(df: DataFrame, metadata: Metadata, approx: bool = False) -> DataFrame:
    long = _unpivot(df, metadata)
    if approx:
        value = F.coalesce(F.col("k").cast("string"), F.col("x").cast("string"), F.col("t"))
        stats = long.groupBy("o").agg(
            F.count(value).alias("count"),
            F.approx_count_distinct(value, APPROX_RSD).alias("unique_count"),
            F.count_if(value.isNull()).alias("nulls"),
            F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"),
            F.stddev_samp("x").alias("std"), F.percentile_approx("x", 0.5, 100000).cast("double").alias("median"),
        )
        return _finish(df, metadata, stats)

    spark = df.sparkSession
    cells = long.select("o", "k", "x", *[F.when(F.col("t").isNotNull(), h).alias(n) for n, h in (
        ("t1", F.xxhash64("t")), ("t2", F.xxhash64(F.lit(1), "t")))])
    # the table may be the end of a long plan: it is computed once, for all that follows
    pairs = cells.groupBy("o", "k", "x", "t1", "t2").agg(F.count(F.lit(1)).alias("c")).persist()
    present = F.col("k").isNotNull() | F.col("x").isNotNull() | F.col("t1").isNotNull()
    valued = pairs.where(F.col("x").isNotNull()).select("o", "x", "c")
    try:
        summary = {r["o"]: r for r in pairs.groupBy("o").agg(
            F.sum(F.when(present, F.col("c")).otherwise(0)).alias("count"), F.count_if(present).alias("unique"),
            F.sum(F.when(~present, F.col("c")).otherwise(0)).alias("nulls"),
            F.sum(F.when(F.col("x").isNotNull(), F.col("c")).otherwise(0)).alias("nx"),
            F.sum(F.col("x") * F.col("c")).alias("sx"), F.min("x").alias("min"), F.max("x").alias("max"),
        ).collect()}  # a row a column
        means = {o: r["sx"] / r["nx"] for o, r in summary.items() if r["nx"]}
        squares, middle = {}, {}
        if means:
            known = local_frame(spark, list(means.items()), MEANS)
            squares = {r["o"]: r["ss"] for r in valued.join(F.broadcast(known), "o").groupBy("o").agg(
                F.sum(F.col("c") * (F.col("x") - F.col("mean")) ** 2).alias("ss")).collect()}  # a row a column
            middle = medians(valued, {o: (summary[o]["nx"], summary[o]["min"], summary[o]["max"]) for o in means})
    finally:
        pairs.unpersist()
    rows = []
    for o, r in summary.items():
        std = math.sqrt(squares[o] / (r["nx"] - 1)) if r["nx"] > 1 else None
        rows.append((o, r["count"], r["unique"], r["nulls"], means.get(o), r["min"], r["max"], std, middle.get(o)))
    return _finish(df, metadata, local_frame(spark, rows, SUMMARY))
