"""Sharding by jump consistent hashing; DataFrame functions only.

A document's key (60 bits of the SHA-256 of its id) starts a linear congruential sequence; each number of
it says at how many shards the document jumps next, always into the newest shard of that moment. The
last jump within the number of shards is its place, so there is no ring table, id and shard count alone
decide, and with one more shard a document either stays or moves into that shard. The 64-bit products
are put together from limbs, since SQL arithmetic doesn't wrap around.

Slots number a shard's rows without gaps, in the order of a hash of what is known of a row. The order
is cut in ``BUCKETS`` ranges a shard; rows are numbered within a range, and the ranges' sums (at most
BUCKETS rows a shard) are added. Rows equal in id, size and CRC are counted before they are shuffled and
written out again in parts of at most ``PART`` copies, so no group of them has to fit a task.

Defined results: a null id is an id like others; a null text has no bytes (size 16, CRC 0), like an
empty one; repeated rows get a slot each; texts are read whole; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD, BUCKETS, PART = 16, 1024, 1 << 16

#: Fixed value: the multiplier of the published jump hash's generator.
MULTIPLIER = 2862933555777941757

#: Jumps that are tried at first; documents that need more (hardly any) go on to the end.
FIRST_STEPS = 24

_LOW = (1 << 32) - 1


def _let(value: Column, body) -> Column:
    """``body`` over a name bound to ``value``, which is then computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2 ** 64, in 32-bit limbs so that nothing overflows."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    low, high = key.bitwiseAND(_LOW), F.shiftrightunsigned(key, 32)
    # low * m_low in two parts of 48 bits
    first, second = low * (m_low & 0xFFFF), low * (m_low >> 16)
    bottom = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(second, 16)

    def limb(a: Column, m: int) -> Column:  # the lowest 32 bits of a product of 32-bit numbers
        return (a * (m & 0xFFFF) + F.shiftleft((a * (m >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)

    top = (carry + limb(high, m_low) + limb(low, m_high)).bitwiseAND(_LOW)
    return F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(_LOW))


def jumps(key: Column, shards: int) -> Column:
    """Struct of ``shard`` (the last jump below ``shards``) and ``beyond`` (the next one)."""
    if shards < 1:
        raise ValueError("shards must be 1 or more.")

    def step(state: Column, _: Column) -> Column:
        return F.when(state.getField("beyond") >= shards, state).otherwise(_let(
            next_key(state.getField("key")), lambda k: F.struct(
                state.getField("beyond").alias("shard"),
                F.floor((state.getField("beyond") + 1).cast("double") * (
                    F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long").alias("beyond"),
                k.alias("key"))))

    def go(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("beyond"), key.alias("key"))
    # every jump goes up, so as many steps as shards are always enough
    return _let(go(start, min(FIRST_STEPS, shards)),
                lambda s: F.when(s.getField("beyond") >= shards, s).otherwise(go(s, shards)))


def hash_key(*parts: Column) -> Column:
    """60 bits of the SHA-256 of the parts as text, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def shard_of(doc_id: Column, shards: int) -> Column:
    """The shard of an id."""
    return jumps(hash_key(doc_id), shards)["shard"].cast("int")


def shard_documents(df: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", hash_key(F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("h")).groupBy(
        "doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.withColumn("to", jumps(hash_key(F.col("doc_id")), shards)).select(
        "doc_id", "size", "text_crc32", "h", "m", F.col("to.shard").cast("int").alias("shard"),
        F.when(F.col("to.beyond") == shards, shards).otherwise(F.col("to.shard")).cast("int").alias("grown_shard"),
        F.floor(F.col("h") / F.lit((1 << 60) // BUCKETS)).alias("bucket"))
    # numbers within a range of the order, then the ranges below
    line = Window.partitionBy("shard", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    ranges = rows.groupBy("shard", "bucket").agg(F.sum("m").alias("m"))
    below = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"),
                           F.coalesce(F.sum("m").over(below), F.lit(0)).alias("_below"))
    rows = rows.join(ranges, (F.col("shard") == F.col("_shard")) & (F.col("bucket") == F.col("_bucket"))).withColumn(
        "before", F.col("before") + F.col("_below"))

    def written(parts: DataFrame) -> DataFrame:
        return parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("before") + F.col("i")).alias("slot"), "grown_shard")

    # copies beyond PART leave their task in parts
    many = rows.where(F.col("m") > PART).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(PART)))).withColumn(
        "before", F.col("before") + F.col("part")).withColumn(
        "m", F.least(F.col("m") - F.col("part"), F.lit(PART))).repartition("h", "part").drop("part")
    return written(rows.where(F.col("m") <= PART)).unionByName(written(many))


def write_shards(df: DataFrame, path: str, shards: int = 40, files: int = 1) -> None:
    """All columns of ``df``, one folder a shard with about ``files`` Parquet files each. The rows that a file
    takes come from a hash of id and text, so no shard has to pass through one task."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name, part = "shard", F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(files))
    if name in df.columns:
        raise ValueError(f"The column {name!r} names the folders; rename it first.")
    df.withColumn(name, shard_of(F.col("doc_id"), shards)).repartition(F.col(name), part).write.partitionBy(name).parquet(path)
