"""Rows by their place in the files they were read from.

A DataFrame has no row order, but files have: files by path, and rows as they are stored. Formats that number
their rows (Parquet) give a row's place in its file directly; others (CSV, JSON, text) give the block
of the file that a task read and the row's turn in that task. ``with_places`` adds these as three columns by a
projection, with no shuffle. ``with_position`` makes them one dense number, 0 for the first row.

Defined results: an empty table stays empty; empty files take no number; equal rows keep places of their own. A
table that isn't a plain read of files (rows filtered, joined, unioned or generated) has no file order: ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._util import qcol
from ..plans.ranking import fits_broadcast, materialize

#: Columns of a row's place: its file, where the block of the file begins that a task read, its turn therein.
PLACE = ("__pos_file", "__pos_block", "__pos_row")

#: Plan nodes that keep each row of a scan, in order.
_KEEP_ROWS = ("Project", "SubqueryAlias", "View")


def _is_plain_read(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _KEEP_ROWS:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.children().isEmpty() and bool(df.inputFiles())


def with_places(df: DataFrame) -> DataFrame:
    """``df`` plus the columns of ``PLACE``, whose order is the order of the files' rows."""
    taken = {c.lower() for c in df.columns} & set(PLACE)
    if taken:
        raise ValueError(f"Column names {sorted(taken)} are reserved for row positions.")
    if df.isStreaming or not _is_plain_read(df):
        raise ValueError("Only a table read from files, with all its rows, has a file order.")
    at = df.select(*[qcol(c) for c in df.columns], F.col("_metadata").alias(PLACE[0]))
    if _numbered(df):
        block, row = F.lit(0).cast("long"), F.col(f"{PLACE[0]}.row_index")
    else:
        block, row = F.col(f"{PLACE[0]}.file_block_start"), F.monotonically_increasing_id()
    return at.select(*[qcol(c) for c in df.columns], F.col(f"{PLACE[0]}.file_path").alias(PLACE[0]),
                     block.alias(PLACE[1]), row.alias(PLACE[2]))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2... in file order.

    Rows are counted per file and block, and running sums over these counts give each block's first number. The
    table of counts has one row a block, so its size goes with the listing of files the driver holds anyway; it is
    broadcast only if it fits the threshold. Where turns depend on the cut into tasks (no row numbers in the
    files), the rows are written to the scratch folder first, so that all uses see the same cut.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"The table already has a column '{name}'.")
    cols = list(df.columns)
    placed = with_places(df)
    if not _numbered(df):
        placed = materialize(placed, "places")
    file, block, row = (F.col(c) for c in PLACE)
    per = placed.groupBy(file, block).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first"))
    before = Window.partitionBy(PLACE[0]).orderBy(PLACE[1]).rowsBetween(Window.unboundedPreceding, -1)
    files = per.groupBy(file).agg(F.sum("__n").alias("__n"))
    earlier = Window.orderBy(PLACE[0]).rowsBetween(Window.unboundedPreceding, -1)  # one row a file, as the driver lists
    starts = (per.withColumn("__in_file", F.coalesce(F.sum("__n").over(before), F.lit(0)))
              .join(files.select(file, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__files")), PLACE[0])
              .select(file.alias("__f"), block.alias("__b"),
                      (F.col("__files") + F.col("__in_file") - F.col("__first")).alias("__start")))
    # files that the driver lists anyway; blocks are counted in the written table
    blocks = len(df.inputFiles()) if _numbered(df) else placed.select(file, block).distinct().count()
    size = blocks * (24 + max((len(f) for f in df.inputFiles()), default=0))
    if fits_broadcast(df.sparkSession, blocks, size):
        starts = F.broadcast(starts)
    return placed.join(starts, (file == F.col("__f")) & (block == F.col("__b"))).select(
        *[qcol(c) for c in cols], (F.col("__start") + row).alias(name))


def _numbered(df: DataFrame) -> bool:
    """Whether the files' format numbers its rows."""
    return "row_index" in df.select("_metadata").schema["_metadata"].dataType.names
