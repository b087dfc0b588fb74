"""Random (irreversible) and order-preserving (reversible) pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._util import is_hashable, dtype_of, qcol, reject_nested
from ..functions.hashing import new_secret, pseudonym_token, secret_value
from ..plans.ranking import RankTable, dense_rank_mapping


def random_pseudonyms(
    df: DataFrame, columns: list[str], secret: str | None = None, keep_nulls: bool = False
) -> DataFrame:
    """Replace each value by ``ID-<63-bit number>``; equal values share a token, output is string.

    A projection only: no shuffle, no mapping table. Without ``secret`` a fresh random one is
    drawn and discarded, so tokens cannot be reversed. Passing a ``secret`` makes tokens
    reproducible (tests, linking tables); keep it as safe as the data, since low-entropy
    identifiers can be found by trying candidates once it leaks. Null receives a token of its
    own, as in the reference, unless ``keep_nulls``.
    """
    updates = {}
    for c in columns:
        dt = dtype_of(df, c)
        reject_nested(dt, c)
        updates[c] = pseudonym_token(qcol(c), dt, secret_value(df.sparkSession, secret or new_secret()), c, keep_nulls)
    return df.withColumns(updates)


def rank_mapping(df: DataFrame, column: str) -> RankTable:
    """``(value, rank)`` for the distinct non-null values of ``column``, dense-ranked 1..U."""
    dt = dtype_of(df, column)
    reject_nested(dt, column)
    return dense_rank_mapping(df.select(qcol(column).alias("v")), "v")


def lookup(df: DataFrame, key: Column, ranks: RankTable, key_col: str, val_col: str) -> tuple[DataFrame, Column]:
    """Left-join ``df`` to the mapping on ``key`` = ``ranks.table[key_col]``; returns (joined, value).

    Small mapping (measured): one broadcast hash join, the data side is not shuffled.
    Large mapping: both sides shuffle on the key. Hot keys - values holding more than one
    partition's fair share of rows, a set bounded by the partition count - are answered by a
    broadcast join first and leave the shuffle with a null key; rows with a null key are spread
    over all partitions by a salt (a hash of the row) in the join key. The mapping side is never
    replicated, so one value holding a third of all rows costs nothing extra and lands in no
    single task.
    Row count and pairing are kept: the mapping is unique on ``key_col``.
    """
    if ranks.small:
        m = F.broadcast(ranks.table.select(F.col(key_col).alias("__lk"), F.col(val_col).alias("__lv")))
        return df.join(m, key == F.col("__lk"), "left").drop("__lk"), F.col("__lv")
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df
    k = key
    hot_val = None
    if ranks.hot is not None:
        h = F.broadcast(ranks.hot.select(F.col(key_col).alias("__hk"), F.col(val_col).alias("__hv")))
        out = out.join(h, key == F.col("__hk"), "left").drop("__hk")
        k = F.when(F.col("__hv").isNull(), key)
        hot_val = F.col("__hv")
    # the salt is a hash of the row, not rand(): a retried map task must send every row to the
    # same reducer as before. Rows identical in every column share a salt; AQE's skew split
    # (deterministic, by map-output ranges) handles a partition made hot by such copies.
    # Columns that Spark can't hash (maps) are left out.
    row_hash = F.xxhash64(*[qcol(f.name) for f in df.schema.fields if is_hashable(f.dataType)])
    out = out.withColumn("__sk", k).withColumn(
        "__salt", F.when(F.col("__sk").isNull(), F.pmod(row_hash, F.lit(salts)).cast("int") + 1).otherwise(F.lit(0)))
    m = ranks.data.select(F.col(key_col).alias("__ck"), F.col(val_col).alias("__cv"), F.col("__zero").alias("__csalt"))
    out = out.join(m, (F.col("__sk") == F.col("__ck")) & (F.col("__salt") == F.col("__csalt")), "left")
    out = out.drop("__sk", "__salt", "__ck", "__csalt")
    val = F.col("__cv") if hot_val is None else F.coalesce(hot_val, F.col("__cv"))
    return out, val


def _finish_lookup(joined: DataFrame, df: DataFrame, column: str, value: Column) -> DataFrame:
    helpers = [c for c in ("__lv", "__hv", "__cv") if c in joined.columns]
    return joined.withColumn(column, value).drop(*helpers).select(*[qcol(c) for c in df.columns])


def apply_rank_mapping(df: DataFrame, column: str, mapping: RankTable) -> DataFrame:
    """Replace values by their rank (``LongType``); nulls stay null."""
    joined, rank = lookup(df, qcol(column), mapping, "value", "rank")
    return _finish_lookup(joined, df, column, rank)


def reverse_rank_mapping(df: DataFrame, column: str, mapping: RankTable, original_type: T.DataType) -> DataFrame:
    """Ranks back to original values; anything that is not a rank passes through unchanged.

    Matching follows a lookup with integer keys: integers match, a fractional number matches only
    when it is integral, and text never matches (the column is then returned as it is, text).
    Unmatched numbers are returned in the original type.
    """
    dtype = dtype_of(df, column)
    c = qcol(column)
    if isinstance(dtype, T.IntegralType):
        key = c.cast("long")
    elif isinstance(dtype, (T.FractionalType, T.DecimalType)):
        key = F.when(c == F.floor(c), c.try_cast("long"))
    else:
        return df
    joined, value = lookup(df, key, mapping, "rank", "value")
    return _finish_lookup(joined, df, column, F.coalesce(value, c.try_cast(original_type)))


def order_preserving_pseudonyms(df: DataFrame, column: str) -> tuple[DataFrame, RankTable]:
    mapping = rank_mapping(df, column)
    return apply_rank_mapping(df, column, mapping), mapping
