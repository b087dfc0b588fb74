"""Positions of rows in a total order, without a single-task window over the rows.

Rows are dealt by range of their order and sorted within each task; what a task holds of a group is
one row of a small table, whose running sums tell where each task's part begins. Equal rows are told
apart by their place in the input, so a key that holds a third of all rows still spans several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table (a few numbers each) up to which it is broadcast.
BROADCAST_ROWS = 100_000

_AT = (1 << 33) - 1


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; it must be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_places(rows: DataFrame, order: list[Column], group: str | None = None,
                details: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 0) in its group and ``group_rows``.

    ``rows`` is read twice, so it should be written already (a checkpoint). ``group`` may be null.
    ``details`` holds one row a group, with columns to add.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + order
    # the salt is a place in written rows, so it is the same whenever they are read
    laid = rows.withColumn("_salt", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(*keys, F.col("_salt")).sortWithinPartitions(*keys, F.col("_salt")).drop("_salt")
    laid = laid.select("*", F.spark_partition_id().alias("_part"),
                       F.monotonically_increasing_id().bitwiseAND(_AT).alias("_at")).checkpoint()
    own = [F.col(group).alias("_group")] if group else [F.lit(0).alias("_group")]
    # one row a task and group; without groups the windows see one row a task
    parts = laid.select("_part", "_at", *own).groupBy("_part", "_group").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy("_group")
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_group", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_n").over(of_group).alias("group_rows"))
    if details is not None:
        extra = [c for c in details.columns if c != group]
        parts = parts.join(details.select(F.col(group).alias("_g"), *extra), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    parts = parts.withColumnRenamed("_part", "_of").checkpoint()
    same = F.col("_part") == F.col("_of")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_group"))
    return laid.join(bounded(parts), same).withColumn("place", F.col("_at") + F.col("_shift")).drop(
        "_part", "_at", "_of", "_group", "_shift")
