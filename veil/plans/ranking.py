"""Global positions over sorted data without a single-partition window.

``dense_rank().over(Window.orderBy(v))`` moves every row into one partition. Instead the values
are range-partitioned and sorted within partitions; each row records its partition id and its
position inside the partition, and the result is written as parquet into the cluster's shared
checkpoint folder (``spark.checkpoint.dir``). That cuts the lineage, so the sampled range
boundaries cannot change between later uses, survives executor loss, and gives Spark real file
sizes and per-file ``__pid`` statistics (later filters on ``__pid`` skip whole files).
Per-partition totals form a table with one row per partition - a size fixed by configuration,
not by data - whose running sums give each partition's offset; that table is broadcast back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import local_frame
from ..session import remove_tree, scratch_path, scratch_root

OFFSETS = T.StructType([T.StructField("__pid", T.IntegerType()), T.StructField("__off", T.LongType())])
_POS_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the in-partition row number in 33 bits
HASH_ENTRY_OVERHEAD = 32  # bytes per row a broadcast hash relation adds on top of the payload


def range_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release_scratch(df: DataFrame, name: str = "") -> None:
    """Delete the scratch tables (of that name) that ``df`` reads; they hold original values in the clear."""
    for path in {scratch_root(f) for f in df.inputFiles()} - {None}:
        if path.rsplit("/", 1)[-1].startswith(f"veil-{name}"):
            remove_tree(df.sparkSession, path)


def sorted_positions(df: DataFrame, order: list[str], partitions: int | None = None,
                     name: str = "positions") -> DataFrame:
    """``df`` plus ``__pid`` (range partition) and ``__pos`` (0-based row within it), materialized."""
    p = partitions or range_partitions(df)
    cols = [F.col(c) for c in order]
    staged = (
        df.repartitionByRange(p, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)))
    )
    return materialize(staged, name)


def check_positions(widest: int | None) -> None:
    """Positions come from the low 33 bits of ``monotonically_increasing_id``; refuse to go past them."""
    if widest is not None and widest > _POS_MASK:
        raise ValueError(f"A range partition holds {widest} rows, more than 2^33; raise "
                         "spark.sql.shuffle.partitions so each partition holds fewer.")


def running_offsets(per: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """Add ``__off``: total ``weight`` of all earlier partitions (per ``by`` group).

    ``per`` has one row per (group, partition); the window runs over that small table only.
    """
    by = by or []
    running = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("__off", F.coalesce(F.sum(weight).over(running), F.lit(0)).cast("long"))


def _payload_bytes(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return F.lit(16 if isinstance(dtype, T.DecimalType) else 8).cast("long")


def broadcast_limit(spark) -> int:
    """The session's broadcast threshold in bytes (-1: broadcasting disabled)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for u in sorted(units, key=len, reverse=True):
        if raw.endswith(u):
            return int(float(raw[: -len(u)]) * units[u])
    return int(raw)


def fits_broadcast(spark, rows: int, payload: int) -> bool:
    limit = broadcast_limit(spark)
    return 0 <= payload + HASH_ENTRY_OVERHEAD * rows <= limit


@dataclass(frozen=True)
class RankTable:
    """``(value, rank)`` plus sizes measured when it was built, and its hot keys.

    ``data`` also carries ``__zero``, a stored column of zeros: the shuffle join matches it against
    the data side's salt. Being read from files, the optimizer cannot fold it into a constant and
    drop the salt from the join's hash partitioning.
    ``hot`` holds the values whose row count exceeds one partition's fair share of the data
    (fewer such values than range partitions, so its size is bounded by configuration); it is ``None``
    when there is no such value or the hot set does not fit the broadcast threshold.
    """

    data: DataFrame
    rows: int
    bytes: int
    hot: DataFrame | None = None

    @property
    def table(self) -> DataFrame:
        return self.data.select("value", "rank")

    @property
    def small(self) -> bool:
        return fits_broadcast(self.data.sparkSession, self.rows, self.bytes)


def dense_rank_mapping(values: DataFrame, column: str) -> RankTable:
    """Distinct non-null values of ``column`` ranked 1..U ascending, with per-value row counts."""
    v = F.col(column)
    counted = (values.select(v.alias("value")).where(F.col("value").isNotNull())
               .groupBy("value").agg(F.count(F.lit(1)).alias("__cnt")).withColumn("__zero", F.lit(0)))
    positioned = sorted_positions(counted, ["value"], name="positions")
    spark = positioned.sparkSession
    dtype = positioned.schema["value"].dataType
    size = _payload_bytes(F.col("value"), dtype)
    per = sorted(positioned.groupBy("__pid").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__bytes"),
        F.sum("__cnt").alias("__rows"), F.max("__cnt").alias("__max"),
    ).collect())  # one row a range partition: bounded by configuration
    check_positions(max((r["__n"] for r in per), default=None))
    offsets, rows = [], 0
    for r in per:
        offsets.append((r["__pid"], rows))
        rows += r["__n"]
    ranked = materialize(positioned.join(F.broadcast(local_frame(spark, offsets, OFFSETS)), "__pid").select(
        "value", (F.col("__off") + F.col("__pos") + 1).alias("rank"), "__cnt", "__zero"), "ranks")
    release_scratch(positioned)
    mapping = ranked.select("value", "rank", "__zero")
    payload = sum(r["__bytes"] or 0 for r in per)
    hot = None
    share = -(-sum(r["__rows"] for r in per) // range_partitions(ranked))  # rows per partition if spread evenly
    if not fits_broadcast(spark, rows, payload) and max((r["__max"] for r in per), default=0) > share:
        candidate = ranked.where(F.col("__cnt") > share).select("value", "rank")
        hs = candidate.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
        if fits_broadcast(spark, int(hs["n"]), int(hs["b"] or 0)):
            hot = candidate
    return RankTable(mapping, rows, payload, hot)
