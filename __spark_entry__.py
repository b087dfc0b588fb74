"""

Every query reads the driver's tables in full. Oracle SQL recomputes the same result from the
documented semantics (hash tokens, dense ranks, label-rounded bin midpoints, keyed Box-Muller
noise, string masks, weighted equality counts, per-column statistics) so the two are independent.
Doubles whose computation order differs between engines are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from veil import Metadata, Release, read_csv  # noqa: E402
from veil.functions.hashing import new_secret, pseudonym_token, secret_value  # noqa: E402
from veil.functions.sql import register_sql_functions  # noqa: E402
from veil.operators.metrics import precision_privacy_between, precision_privacy_by_position  # noqa: E402
from veil.operators.positions import with_position  # noqa: E402
from veil.operators.perturb import perturb as perturb_df  # noqa: E402
from veil.session import ensure_checkpoint_dir, scratch_path  # noqa: E402
from veil.streaming import BinModel, NoiseModel, mask_stream, pseudonymize_stream  # noqa: E402

try:  # the training-text operators are an optional subpackage; without it everything else works
    from veil.llm import queries as text_queries
except ImportError as e:
    if not (e.name or "").startswith("veil.llm") and "veil.llm" not in str(e):
        raise
    text_queries = None
try:
    import corpus_pipeline
except ImportError as e:
    if not (e.name or "").startswith(("veil.llm", "corpus_pipeline")) and "veil.llm" not in str(e):
        raise
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Fixed parameters shared by the Spark queries and their oracles.
SECRET = "veil-oracle-secret"
SEED = 42

CUSTOMER_META = Metadata(
    column_types={"c_custkey": "numeric", "c_name": "categorical", "c_nationkey": "numeric",
                  "c_acctbal": "numeric", "c_mktsegment": "categorical"},
    identifiers=["c_custkey", "c_name"],
    quasi_identifiers=["c_nationkey", "c_mktsegment"],
    sensitive_attributes=["c_acctbal"],
)
ORDERS_META = Metadata(
    column_types={"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
                  "o_totalprice": "numeric", "o_orderdate": "categorical", "o_orderpriority": "categorical"},
    identifiers=["o_custkey"],
    sensitive_attributes=["o_totalprice"],
)
EVENTS_META = Metadata(
    column_types={"event_id": "numeric", "ts": "categorical", "user_id": "numeric", "event_type": "categorical",
                  "value": "numeric", "props": "categorical"},
    identifiers=["event_id", "user_id"],
    sensitive_attributes=["value"],
)
SUPPLIER_META = Metadata(
    column_types={"s_suppkey": "numeric", "s_name": "categorical", "s_nationkey": "numeric", "s_acctbal": "numeric"},
    identifiers=["s_suppkey"],
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------

def _customer(spark, sf_dir) -> Release:
    return Release(_t(spark, sf_dir, "customer"), CUSTOMER_META)


def _pipeline(spark, sf_dir) -> Release:
    """Flagship: keyed pseudonyms on the key, masked names, generalized balances."""
    return (
        _customer(spark, sf_dir)
        .random_pseudonyms("c_custkey", secret=SECRET)
        .mask("c_name", "mask_last_k", k=4)
        .generalize("c_acctbal", bins=10)
    )


def q_release_pipeline(spark, sf_dir):
    return _pipeline(spark, sf_dir).working()


def q_pseudonym_seeded(spark, sf_dir):
    return _customer(spark, sf_dir).random_pseudonyms("c_name", secret=SECRET).working().select("c_custkey", "c_name")


def _orders_with_null_customers(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.withColumn("o_custkey", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_custkey")))


def q_pseudonym_nulls(spark, sf_dir):
    r = Release(_orders_with_null_customers(spark, sf_dir), ORDERS_META)
    return r.random_pseudonyms("o_custkey", secret=SECRET).working().select("o_orderkey", "o_custkey")


def q_pseudonym_keep_nulls(spark, sf_dir):
    r = Release(_orders_with_null_customers(spark, sf_dir), ORDERS_META)
    return r.random_pseudonyms("o_custkey", secret=SECRET, keep_nulls=True).working().select("o_orderkey", "o_custkey")


def q_pseudonym_random_invariants(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    c = F.col("o_custkey")
    a = pseudonym_token(c, o.schema["o_custkey"].dataType, secret_value(spark, new_secret()), "o_custkey")
    b = pseudonym_token(c, o.schema["o_custkey"].dataType, secret_value(spark, new_secret()), "o_custkey")
    t = o.select(c.alias("v"), a.alias("a"), b.alias("b"))
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("v").alias("distinct_in"),
        F.count_distinct("a").alias("distinct_out"),
        F.count_distinct("v", "a").alias("distinct_pairs"),
        F.count_if(F.col("a").rlike(r"^ID-[0-9]+$")).alias("well_formed"),
        F.count_if(F.col("a") != F.col("b")).alias("differ_between_runs"),
    )


def q_ope_int(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "orders"), ORDERS_META)
    return r.order_preserving_pseudonyms("o_custkey").working().select("o_orderkey", "o_custkey")


def q_ope_string(spark, sf_dir):
    return _customer(spark, sf_dir).order_preserving_pseudonyms("c_name").working().select("c_custkey", "c_name")


def q_ope_nulls(spark, sf_dir):
    r = Release(_orders_with_null_customers(spark, sf_dir), ORDERS_META)
    return r.order_preserving_pseudonyms("o_custkey").working().select("o_orderkey", "o_custkey")


def q_ope_mapping(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META).order_preserving_pseudonyms("user_id")
    return r.mapping("user_id")


def q_ope_roundtrip(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META)
    return r.order_preserving_pseudonyms().reverse_pseudonyms().working().select("event_id", "user_id")


def q_ope_reverse_forced(spark, sf_dir):
    """Rank, generalize the ranks, reverse anyway: ranks map back, other values pass through."""
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META).order_preserving_pseudonyms("user_id")
    r = r.generalize("user_id", bins=7).reverse_pseudonyms("user_id", force=True)
    return r.working().select("event_id", "user_id")


def q_ope_reverse_passthrough(spark, sf_dir):
    """Rank, then replace the ranks by tokens, reverse anyway: text never matches a rank and passes through."""
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META).order_preserving_pseudonyms("user_id")
    r = r.random_pseudonyms("user_id", secret=SECRET).reverse_pseudonyms("user_id", force=True)
    return r.working().select("event_id", "user_id")


def q_generalize_int(spark, sf_dir):
    part = Release(_t(spark, sf_dir, "part"), Metadata({"p_size": "numeric"}))
    return part.generalize("p_size", bins=10).working().select("p_partkey", "p_size")


def q_generalize_truncate(spark, sf_dir):
    part = Release(_t(spark, sf_dir, "part"), Metadata({"p_size": "numeric"}))
    return part.generalize("p_size", bins=10, rounding="truncate").working().select("p_partkey", "p_size")


def q_generalize_float(spark, sf_dir):
    return _customer(spark, sf_dir).generalize("c_acctbal", bins=10).working().select("c_custkey", "c_acctbal")


def q_generalize_no_lowest(spark, sf_dir):
    r = _customer(spark, sf_dir).generalize("c_acctbal", bins=10, include_lowest=False)
    return r.working().select("c_custkey", "c_acctbal")


def q_generalize_many_bins(spark, sf_dir):
    r = _customer(spark, sf_dir).generalize("c_acctbal", bins=200)
    return r.working().select("c_custkey", "c_acctbal")


def q_generalize_constant(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", F.greatest(F.col("p_size"), F.lit(100)).cast("double").alias("v"))
    return Release(part, Metadata({"v": "numeric"})).generalize("v", bins=4).working()


def _customer_with_null_balances(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.col("c_acctbal")))


def q_generalize_nulls(spark, sf_dir):
    r = Release(_customer_with_null_balances(spark, sf_dir), CUSTOMER_META).generalize("c_acctbal", bins=5)
    return r.working().select("c_custkey", "c_acctbal")


def q_generalize_fine_bins(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return Release(li, Metadata({"l_extendedprice": "numeric"})).generalize("l_extendedprice", bins=5000).working()


def q_perturb_nonunique_identifier(spark, sf_dir):
    """Unkeyed noise with an identifier that repeats: rows draw their noise one by one."""
    f = Release(_t(spark, sf_dir, "orders"), ORDERS_META).perturb("o_totalprice", noise_std=0.01, random_state=SEED).frame
    noise = F.round(F.col("o_totalprice") - F.col("__orig_o_totalprice"), 6)
    return f.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_identifiers"),
                 (F.count_distinct(noise) > 0.99 * F.count(F.lit(1))).alias("noise_by_row"))


def q_reset_working(spark, sf_dir):
    r = _pipeline(spark, sf_dir).order_preserving_pseudonyms("c_custkey").reset()
    return r.working().withColumn("n_mappings", F.lit(len(r.ope_mapping_columns)))


def q_preview_original(spark, sf_dir):
    r = _pipeline(spark, sf_dir)
    return r.preview(15, use_working=False, order_by=["c_custkey"]).withColumn("n_total", F.lit(r.count()).cast("long"))


def q_stats_display(spark, sf_dir):
    return _customer(spark, sf_dir).statistics(digits=4)


def q_precision_display(spark, sf_dir):
    return _pipeline(spark, sf_dir).precision_privacy(digits=1)


def q_stats_documents(spark, sf_dir):
    """Statistics of a table with long texts: texts are counted through digests."""
    meta = Metadata({"doc_id": "numeric", "n_chars": "numeric", "text": "categorical"})
    return _round_stats(Release(_t(spark, sf_dir, "documents"), meta).statistics())


@contextmanager
def _broadcast_threshold(spark, value: str):
    """The session's threshold while a verb picks its join, as for a mapping too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def q_ope_large_mapping(spark, sf_dir):
    """Ranks joined by a shuffle on value and salt: no mapping is broadcast."""
    with _broadcast_threshold(spark, "-1"):
        r = Release(_t(spark, sf_dir, "events"), EVENTS_META).order_preserving_pseudonyms("event_id")
    return r.working().select("event_id", "user_id")


def q_ope_hot_key(spark, sf_dir):
    """A third of all rows hold one value: it is answered by a size-checked broadcast, the rest by the shuffle."""
    o = _t(spark, sf_dir, "orders")
    o = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("o_custkey")))
    with _broadcast_threshold(spark, "1k"):
        r = Release(o, ORDERS_META).order_preserving_pseudonyms("o_custkey")
    return r.working().select("o_orderkey", "o_custkey")


_SUPPLIER_CSV = Metadata({"s_suppkey": "numeric", "s_name": "categorical", "s_acctbal": "numeric"})


def _supplier_lines(spark, sf_dir, missing: str) -> str:
    """CSV files of suppliers, each with a header; odd keys end in ``missing`` instead of a balance."""
    path = scratch_path(spark, "supplier-csv")
    rows = _t(spark, sf_dir, "supplier").select(
        F.pmod(F.xxhash64("s_suppkey"), F.lit(16)).alias("file"), F.col("s_suppkey").cast("long").alias("i"), F.concat(
            F.concat_ws(",", "s_suppkey", "s_name"),
            F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(","), F.col("s_acctbal"))).otherwise(F.lit(missing))).alias("value"))
    header = rows.select("file").distinct().select(
        "file", F.lit(-1).cast("long").alias("i"), F.lit("s_suppkey,s_name,s_acctbal").alias("value"))
    header.unionByName(rows).repartition("file").sortWithinPartitions("file", "i").drop("i").write.partitionBy("file").text(path)
    return path


def q_csv_short_rows(spark, sf_dir):
    return read_csv(spark, _supplier_lines(spark, sf_dir, ""), _SUPPLIER_CSV, recursiveFileLookup="true")


def q_csv_schema_na(spark, sf_dir):
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
                           T.StructField("s_acctbal", T.DoubleType())])
    return read_csv(spark, _supplier_lines(spark, sf_dir, ",NA"), schema=schema, recursiveFileLookup="true")


def q_csv_multiline(spark, sf_dir):
    """Fields with line breaks and quotes, read back by lines: blocks of a file may begin within a field."""
    path = scratch_path(spark, "csv-lines")
    note = F.concat(F.col("o_orderpriority"), F.repeat(F.lit("\n"), (F.col("o_orderkey") % 3).cast("int")), F.lit('"'),
                    F.col("o_orderstatus"), F.lit('",'), F.when(F.col("o_orderkey") % 2 == 0, F.lit("\n.")).otherwise(F.lit(".")))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    md = Metadata({"o_orderkey": "numeric", "note": "categorical", "o_totalprice": "numeric"})
    Release(orders, md).export_csv(path)
    return read_csv(spark, path, md)


def q_csv_multi_file(spark, sf_dir):
    path = scratch_path(spark, "csv-parts")
    Release(_t(spark, sf_dir, "customer").repartition(5, "c_custkey"), CUSTOMER_META).export_csv(path)
    return read_csv(spark, path, CUSTOMER_META)


def q_export_columns(spark, sf_dir):
    path = scratch_path(spark, "csv-columns")
    _customer(spark, sf_dir).export_csv(path, columns=["c_acctbal", "c_custkey"], float_format="%.2f")
    return read_csv(spark, path, Metadata({"c_custkey": "numeric", "c_acctbal": "numeric"}))


def q_perturb_seeded(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META)
    r = r.perturb("value", noise_std=0.1, random_state=SEED, key=["event_id"])
    return r.working().select("event_id", F.round("value", 6).alias("value"))


def q_perturb_nulls(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    ev = ev.withColumn("value", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")))
    r = Release(ev, EVENTS_META).perturb("value", noise_std=0.1, random_state=SEED, key=["event_id"])
    return r.working().select("event_id", F.round("value", 6).alias("value"))


def q_perturb_int(spark, sf_dir):
    part = Release(_t(spark, sf_dir, "part"), Metadata({"p_size": "numeric"}, identifiers=["p_partkey"]))
    return part.perturb("p_size", noise_std=0.2, random_state=SEED, key=["p_partkey"]).working().select("p_partkey", "p_size")


def q_perturb_zero_noise(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return perturb_df(li, "l_quantity", noise_std=0.0, random_state=SEED, key=["l_orderkey", "l_linenumber"])


def q_perturb_invariants(spark, sf_dir):
    """Unseeded noise: every value stays within the original [min, max], no value becomes null."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    r = Release(li, Metadata({"l_quantity": "numeric"}, identifiers=["l_orderkey", "l_linenumber"]))
    f = r.perturb("l_quantity", noise_std=0.05).frame
    return f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.min("l_quantity") >= F.min("__orig_l_quantity")) & (F.max("l_quantity") <= F.max("__orig_l_quantity")))
        .alias("bounded"),
        F.count_if(F.col("l_quantity").isNull()).alias("nulls"),
    )


def _mask_query(table: str, key: list[str], column: str, strategy: str, **kw):
    def q(spark, sf_dir):
        df = _t(spark, sf_dir, table)
        r = Release(df, Metadata({}))
        return r.mask(column, strategy, **kw).working().select(*key, column)
    return q


def q_mask_numeric_column(spark, sf_dir):
    return _customer(spark, sf_dir).mask("c_custkey", "mask_first_k", k=2).working().select("c_name", "c_custkey")


def q_precision_untouched(spark, sf_dir):
    return _customer(spark, sf_dir).precision_privacy()


def q_precision_pipeline(spark, sf_dir):
    return _pipeline(spark, sf_dir).precision_privacy()


def q_precision_with_nulls(spark, sf_dir):
    return Release(_customer_with_null_balances(spark, sf_dir), CUSTOMER_META).precision_privacy()


def q_precision_type_change(spark, sf_dir):
    r = _customer(spark, sf_dir).order_preserving_pseudonyms("c_custkey").mask("c_nationkey", "mask_first_k", k=0)
    return r.precision_privacy()


def q_stats_original(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "events"), EVENTS_META)
    return _round_stats(r.statistics(use_working=False))


def q_stats_working(spark, sf_dir):
    r = Release(_t(spark, sf_dir, "orders"), ORDERS_META)
    r = r.random_pseudonyms("o_custkey", secret=SECRET).generalize("o_totalprice", bins=8)
    return _round_stats(r.statistics(use_working=True))


def q_stats_approx(spark, sf_dir):
    """approx=True against the exact statistics: counts and means agree exactly, distinct counts
    within 5% and medians within 1%."""
    r = Release(_t(spark, sf_dir, "orders"), ORDERS_META)
    a = r.statistics(approx=True).alias("a")
    e = r.statistics().alias("e")
    j = a.join(e, "column")

    def near(c, tol):
        return (F.col(f"a.{c}").isNull() & F.col(f"e.{c}").isNull()) | (
            F.abs(F.col(f"a.{c}") - F.col(f"e.{c}")) <= F.lit(tol) * F.abs(F.col(f"e.{c}")))

    return j.select(
        "column", F.col("e.count").alias("count"), F.col("e.nulls").alias("nulls"),
        F.round("e.mean", 6).alias("mean"),
        (F.col("a.count") == F.col("e.count")).alias("count_equal"),
        near("unique_count", 0.05).alias("unique_close"), near("median", 0.01).alias("median_close"),
        near("mean", 1e-9).alias("mean_close"),
    )


def _round_stats(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        "column", "type", "count", "unique_count", "nulls",
        *[F.round(c, digits).alias(c) for c in ("mean", "min", "max", "std", "median")],
    )


def q_csv_roundtrip(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "csv")
    r = Release(_t(spark, sf_dir, "supplier"), SUPPLIER_META)
    r.export_csv(path)
    return read_csv(spark, path, SUPPLIER_META)


def q_precision_between_export(spark, sf_dir):
    """Metric between the original table and a release re-read from its CSV export, aligned on the key."""
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "between")
    orig = _t(spark, sf_dir, "customer")
    _customer(spark, sf_dir).mask("c_name", "mask_last_k", k=4).generalize("c_acctbal", bins=10).export_csv(path)
    back = read_csv(spark, path, CUSTOMER_META).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))
    return precision_privacy_between(orig, back, ["c_custkey"], CUSTOMER_META)


def q_bundle_roundtrip(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "bundle")
    _pipeline(spark, sf_dir).save(path)
    return Release.load(spark, path).working()


ORDERED_META = Metadata(
    column_types={"l_orderkey": "numeric", "l_linenumber": "numeric", "l_extendedprice": "numeric",
                  "l_shipdate": "categorical"},
    identifiers=["l_orderkey"], quasi_identifiers=["l_shipdate"], sensitive_attributes=["l_extendedprice"],
)


def _ordered_release(spark, sf_dir) -> Release:
    """Lines of orders as they stand in the file (no unique key), ranked through a join."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                              F.col("l_shipdate").cast("string").alias("l_shipdate"))
    return (Release(li, ORDERED_META, file_order=True).order_preserving_pseudonyms("l_orderkey")
            .mask("l_shipdate", "mask_last_k", k=11))


def q_export_with_metric(spark, sf_dir):
    """The pipeline's metric, counted while its release is written."""
    return _pipeline(spark, sf_dir).export_with_metric(scratch_path(spark, "measured"))


def q_preview_file_order(spark, sf_dir):
    return _ordered_release(spark, sf_dir).preview(40)


def q_export_file_order(spark, sf_dir):
    """The whole release exported in file order, read again with the number of each row."""
    path = scratch_path(spark, "ordered")
    _ordered_release(spark, sf_dir).export_csv(path)
    return with_position(read_csv(spark, path, ORDERED_META))


def q_precision_by_position(spark, sf_dir):
    """Metric between the table and its re-read export, row by row in file order."""
    path = scratch_path(spark, "aligned")
    _ordered_release(spark, sf_dir).export_csv(path)
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                              F.col("l_shipdate").cast("string").alias("l_shipdate"))
    return precision_privacy_by_position(li, read_csv(spark, path, ORDERED_META), ORDERED_META)


def q_preview(spark, sf_dir):
    return _customer(spark, sf_dir).preview(20, order_by=["c_custkey"])


def q_stream_release(spark, sf_dir):
    """The flagship steps on a file stream (availableNow) with bins fitted on the batch table."""
    batch = _t(spark, sf_dir, "customer")
    model = BinModel.fit(batch, "c_acctbal", bins=10)
    stream = spark.readStream.schema(batch.schema).option("basePath", sf_dir).parquet(f"{sf_dir}/customer*.parquet")
    out = pseudonymize_stream(mask_stream(model.transform(stream), "c_name", "mask_last_k", k=4), ["c_custkey"],
                              secret=SECRET)
    path = scratch_path(spark, "stream")
    q = (out.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).start(f"{path}/out"))
    q.awaitTermination()  # raises what ended the stream; availableNow ends by itself when all is read
    return spark.read.parquet(f"{path}/out")


def q_stream_events(spark, sf_dir):
    """The events table as a stream: tokens for users, keyed noise fitted on the batch, masked digits."""
    batch = _t(spark, sf_dir, "events")
    noise = NoiseModel.fit(batch, "value", key=["event_id"], noise_std=0.1, random_state=SEED)
    stream = spark.readStream.schema(batch.schema).option("basePath", sf_dir).parquet(f"{sf_dir}/events*.parquet")
    out = mask_stream(pseudonymize_stream(noise.transform(stream), ["user_id"], secret=SECRET), "props", "mask_regex",
                      regex_pattern=r"\d+")
    path = scratch_path(spark, "stream-events")
    q = (out.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).start(f"{path}/out"))
    q.awaitTermination()  # raises what ended the stream; availableNow ends by itself when all is read
    return spark.read.parquet(f"{path}/out").select("event_id", "user_id", F.round("value", 6).alias("value"), "props")


def q_sql_functions(spark, sf_dir):
    register_sql_functions(spark, SECRET)
    _t(spark, sf_dir, "customer").createOrReplaceTempView("veil_customer")
    return spark.sql(
        "SELECT c_custkey, veil_mask_first_k(c_name, 3) AS first3, veil_mask_last_k(c_name, 4) AS last4, "
        "veil_mask_before_first_space(c_mktsegment) AS seg_before, veil_mask_after_last_space(c_mktsegment) AS seg_after, "
        "veil_pseudonym(CAST(c_nationkey AS STRING), 'c_nationkey') AS nation_token "
        "FROM veil_customer"
    )


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_META = Metadata(
    column_types={"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
                  "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric",
                  "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "categorical",
                  "l_shipdate": "categorical"},
    identifiers=["l_orderkey", "l_suppkey"],
    quasi_identifiers=["l_partkey", "l_shipdate"],
    sensitive_attributes=["l_extendedprice"],
)


def _lineitem_release(spark, sf_dir) -> Release:
    """All verbs on the largest table: ranks, tokens, bins, keyed noise, masked dates."""
    li = _t(spark, sf_dir, "lineitem").select(*LINEITEM_COLS)
    return (
        Release(li, LINEITEM_META)
        .order_preserving_pseudonyms("l_orderkey")
        .random_pseudonyms("l_suppkey", secret=SECRET)
        .generalize("l_extendedprice", bins=20)
        .perturb("l_quantity", noise_std=0.05, random_state=SEED, key=["l_orderkey", "l_linenumber"])
        .mask("l_shipdate", "mask_after_last_space")
    )


def q_lineitem_release(spark, sf_dir):
    w = _lineitem_release(spark, sf_dir).working()
    return w.withColumn("l_quantity", F.round("l_quantity", 6))


def q_lineitem_precision(spark, sf_dir):
    return _lineitem_release(spark, sf_dir).precision_privacy()


def q_lineitem_stats(spark, sf_dir):
    # means of two-decimal columns over 60,000 rows can end in a 5 at the 7th decimal: keep it
    return _round_stats(_lineitem_release(spark, sf_dir).statistics(), 7)


def entry(spark: SparkSession) -> DataFrame:
    return q_release_pipeline(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = _own_queries()
    if text_queries is not None:
        own |= {name: _with_package(q) for name, q in text_queries.QUERIES.items()}
    if corpus_pipeline is not None:
        own["pipeline"] = _with_package(corpus_pipeline.run)
    return own


def _with_package(query: Callable) -> Callable:
    """Let Python workers started from now on import this repository, wherever the driver was started."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    own = _own_oracles()
    if text_queries is not None:
        own |= text_queries.ORACLES
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL is not None:
        own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "release_pipeline": q_release_pipeline,
        "pseudonym_seeded": q_pseudonym_seeded,
        "pseudonym_nulls": q_pseudonym_nulls,
        "pseudonym_keep_nulls": q_pseudonym_keep_nulls,
        "pseudonym_random_invariants": q_pseudonym_random_invariants,
        "ope_int": q_ope_int,
        "ope_string": q_ope_string,
        "ope_nulls": q_ope_nulls,
        "ope_mapping": q_ope_mapping,
        "ope_roundtrip": q_ope_roundtrip,
        "ope_reverse_forced": q_ope_reverse_forced,
        "ope_reverse_passthrough": q_ope_reverse_passthrough,
        "generalize_int": q_generalize_int,
        "generalize_truncate": q_generalize_truncate,
        "generalize_float": q_generalize_float,
        "generalize_no_lowest": q_generalize_no_lowest,
        "ope_large_mapping": q_ope_large_mapping,
        "ope_hot_key": q_ope_hot_key,
        "csv_short_rows": q_csv_short_rows,
        "csv_schema_na": q_csv_schema_na,
        "csv_multi_file": q_csv_multi_file,
        "csv_multiline": q_csv_multiline,
        "export_columns": q_export_columns,
        "generalize_many_bins": q_generalize_many_bins,
        "generalize_fine_bins": q_generalize_fine_bins,
        "perturb_nonunique_identifier": q_perturb_nonunique_identifier,
        "reset_working": q_reset_working,
        "preview_original": q_preview_original,
        "stats_display": q_stats_display,
        "stats_documents": q_stats_documents,
        "precision_display": q_precision_display,
        "generalize_constant": q_generalize_constant,
        "generalize_nulls": q_generalize_nulls,
        "perturb_seeded": q_perturb_seeded,
        "perturb_nulls": q_perturb_nulls,
        "perturb_int": q_perturb_int,
        "perturb_zero_noise": q_perturb_zero_noise,
        "perturb_invariants": q_perturb_invariants,
        "mask_first_k": _mask_query("documents", ["doc_id"], "text", "mask_first_k", k=5),
        "mask_last_k": _mask_query("conversations", ["conv_id", "turn"], "text", "mask_last_k", k=7),
        "mask_before_space": _mask_query("documents", ["doc_id"], "text", "mask_before_first_space"),
        "mask_after_space": _mask_query("conversations", ["conv_id", "turn"], "text", "mask_after_last_space"),
        "mask_regex": _mask_query("documents", ["doc_id"], "text", "mask_regex", regex_pattern=r"\d+"),
        "mask_regex_email": _mask_query(
            "documents", ["doc_id"], "text", "mask_regex",
            regex_pattern=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
        "mask_numeric_column": q_mask_numeric_column,
        "mask_pages_after_space": _mask_query("pages", ["page_id"], "html", "mask_after_last_space"),
        "mask_pages_regex": _mask_query("pages", ["page_id"], "html", "mask_regex", regex_pattern=r"[0-9]{3,}"),
        "precision_untouched": q_precision_untouched,
        "precision_pipeline": q_precision_pipeline,
        "precision_with_nulls": q_precision_with_nulls,
        "precision_type_change": q_precision_type_change,
        "stats_original": q_stats_original,
        "stats_working": q_stats_working,
        "stats_approx": q_stats_approx,
        "csv_roundtrip": q_csv_roundtrip,
        "precision_between_export": q_precision_between_export,
        "bundle_roundtrip": q_bundle_roundtrip,
        "preview": q_preview,
        "export_with_metric": q_export_with_metric,
        "preview_file_order": q_preview_file_order,
        "export_file_order": q_export_file_order,
        "precision_by_position": q_precision_by_position,
        "stream_release": q_stream_release,
        "stream_events": q_stream_events,
        "sql_functions": q_sql_functions,
        "lineitem_release": q_lineitem_release,
        "lineitem_precision": q_lineitem_precision,
        "lineitem_stats": q_lineitem_stats,
    }


# ---------------------------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------------------------

#: Tables are scanned in file order, so row numbers without an order are the rows' places.
_ORDERED_SQL = (
    "SELECT dense_rank() OVER (ORDER BY l_orderkey) AS l_orderkey, l_linenumber, l_extendedprice, "
    "repeat('*', least(11, length(d))) AS m, position, d FROM (SELECT row_number() OVER () - 1 AS position, l_orderkey, "
    "CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice, CAST(l_shipdate AS VARCHAR) AS d FROM lineitem)")
_ORDERED_SQL = ("SELECT position, l_orderkey, l_linenumber, l_extendedprice, "
                f"left(d, greatest(length(d) - 11, 0)) || m AS l_shipdate FROM ({_ORDERED_SQL})")

_SUPPLIER_HALF = ("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal "
                  "FROM supplier")
_MASK63 = "9223372036854775807"
_TWO48 = "281474976710656.0::DOUBLE"


def _token_sql(x: str, column: str, secret: str = SECRET, keep_nulls: bool = False) -> str:
    tagged = f"CASE WHEN {x} IS NULL THEN 'n:' ELSE 'v:' || CAST({x} AS VARCHAR) END"
    tok = (f"('ID-' || CAST((('0x' || substr(sha256('{secret}|{column}|' || {tagged}), 1, 16))::UBIGINT "
           f"& {_MASK63}) AS VARCHAR))")
    if keep_nulls:
        return f"CASE WHEN {x} IS NULL THEN NULL ELSE {tok} END"
    return tok


def _bins_ctes(src: str, x: str, n: int, include_lowest: bool) -> str:
    """CTEs ending in ``b(i, e_lo, e_hi, mid)``: pandas.cut edges and label midpoints."""
    il = "TRUE" if include_lowest else "FALSE"
    return f"""
    s_ AS (SELECT min({x})::DOUBLE AS mn, max({x})::DOUBLE AS mx FROM {src}),
    a_ AS (SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN 0.001::DOUBLE * abs(mn) ELSE 0.001::DOUBLE END) ELSE mn END AS lo,
                  CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN 0.001::DOUBLE * abs(mx) ELSE 0.001::DOUBLE END) ELSE mx END AS hi,
                  mn = mx AS flat FROM s_),
    e_ AS (SELECT r.i, CASE WHEN r.i = {n} THEN hi
                            WHEN r.i = 0 AND NOT flat THEN lo - (hi - lo) * 0.001::DOUBLE
                            ELSE r.i * ((hi - lo) / {n}) + lo END AS edge
           FROM a_, range(0, {n} + 1) r(i)),
    rf_ AS (SELECT p.p, e_.i, e_.edge,
                   CASE WHEN e_.edge = 0 THEN e_.edge
                        WHEN abs(e_.edge) < 1 THEN round_even(e_.edge, CAST(-floor(log10(abs(e_.edge))) - 1 + p.p AS INTEGER))
                        ELSE round_even(e_.edge, CAST(p.p AS INTEGER)) END AS lab
            FROM e_, range(3, 20) p(p)),
    pc_ AS (SELECT coalesce(min(p), 3) AS prec FROM (SELECT p, count(DISTINCT lab) AS u FROM rf_ GROUP BY p) WHERE u = {n} + 1),
    lb_ AS (SELECT rf_.i, rf_.edge,
                   CASE WHEN rf_.i = 0 AND {il} THEN rf_.lab - pow(10, -pc_.prec) ELSE rf_.lab END AS lab
            FROM rf_, pc_ WHERE rf_.p = pc_.prec),
    b AS (SELECT l.i, l0.edge AS e_lo, l.edge AS e_hi, 0.5::DOUBLE * (l0.lab + l.lab) AS mid
          FROM lb_ l JOIN lb_ l0 ON l0.i = l.i - 1)"""


def _bin_join(alias: str, x: str, include_lowest: bool) -> str:
    il = "TRUE" if include_lowest else "FALSE"
    return f"LEFT JOIN b ON ({alias}.{x} > b.e_lo AND {alias}.{x} <= b.e_hi) OR ({il} AND b.i = 1 AND {alias}.{x} = b.e_lo)"


def _generalize_sql(table_sql: str, key: list[str], x: str, n: int, include_lowest: bool = True,
                    cast: str | None = None, truncate: bool = False) -> str:
    keys = ", ".join(f"t.{k}" for k in key)
    if cast:
        out = f"CAST({'trunc' if truncate else 'round_even'}(b.mid{'' if truncate else ', 0'}) AS {cast})"
    else:
        out = "b.mid"
    return f"""WITH t AS ({table_sql}), {_bins_ctes('t', x, n, include_lowest)}
    SELECT {keys}, {out} AS {x} FROM t {_bin_join('t', x, include_lowest)}"""


def _u48(h: str, start: int) -> str:
    return f"((('0x' || substr({h}, {start}, 12))::BIGINT)::DOUBLE + 0.5::DOUBLE) / {_TWO48}"


def _noise_sql(h: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({_u48(h, 1)})) * cos(2.0::DOUBLE * pi() * {_u48(h, 13)}))"


def _key_part(x: str) -> str:
    """One keyed-noise key part: ``<length>:<text>``, ``-`` for null."""
    return f"coalesce(CAST(length(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _perturb_sql(table: str, key_sql: str, x: str, noise: float, seed: int, select_key: str, cast: str | None,
                 hash_key: str) -> str:
    out = f"least(greatest({x}::DOUBLE + {_noise_sql('h')} * eff, mn), mx)"
    out = f"CAST(round_even({out}, 0) AS {cast})" if cast else f"round({out}, 6)"
    return f"""WITH m AS (SELECT min({x})::DOUBLE AS mn, max({x})::DOUBLE AS mx FROM {table}),
    f AS (SELECT mn, mx, ({noise}::DOUBLE * CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE mx - mn END) AS eff FROM m),
    z AS (SELECT {key_sql}, {x}, sha256('{seed}|{x}|' || {hash_key}) AS h FROM {table})
    SELECT {select_key}, CASE WHEN {x} IS NULL THEN NULL ELSE {out} END AS {x} FROM z, f"""


def _mask_sql(strategy: str, s: str, k: int | None = None, pattern: str | None = None) -> str:
    if strategy == "mask_first_k":
        return f"repeat('*', least({k}, length({s}))) || substr({s}, {k + 1})"
    if strategy == "mask_last_k":
        return (f"CASE WHEN length({s}) <= {k} THEN repeat('*', length({s})) "
                f"ELSE substr({s}, 1, length({s}) - {k}) || repeat('*', {k}) END")
    if strategy == "mask_before_first_space":
        return (f"CASE WHEN instr({s}, ' ') = 0 THEN {s} "
                f"ELSE repeat('*', instr({s}, ' ') - 1) || substr({s}, instr({s}, ' ')) END")
    if strategy == "mask_after_last_space":
        return (f"CASE WHEN instr({s}, ' ') = 0 THEN {s} "
                f"ELSE regexp_replace({s}, '[^ ]*$', '') || repeat('*', length(regexp_extract({s}, '[^ ]*$'))) END")
    return f"regexp_replace({s}, '{pattern}', '*', 'g')"


_ORDERS_NULL_CUST = ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey "
                     "FROM orders")
_CUSTOMER_NULL_BAL = ("SELECT c_custkey, c_name, c_nationkey, "
                      "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment "
                      "FROM customer")


def _pipeline_sql() -> str:
    return f"""WITH t AS (SELECT * FROM customer), {_bins_ctes('t', 'c_acctbal', 10, True)}
    SELECT {_token_sql('t.c_custkey', 'c_custkey')} AS c_custkey,
           {_mask_sql('mask_last_k', 't.c_name', 4)} AS c_name,
           t.c_nationkey, b.mid AS c_acctbal, t.c_mktsegment
    FROM t {_bin_join('t', 'c_acctbal', True)}"""


def _rounded_sql(stats_sql: str, digits: int) -> str:
    rounded = ", ".join(f"round({c}, {digits}) AS {c}" for c in ("mean", "min", "max", "std", "median"))
    return f'SELECT "column", "type", "count", unique_count, nulls, {rounded} FROM ({stats_sql})'


def _pipeline_precision_sql() -> str:
    return _precision_simple(
        f"SELECT t.*, p.c_name AS w_name, p.c_acctbal AS w_acctbal FROM customer t JOIN ({_pipeline_sql()}) p "
        f"ON {_token_sql('t.c_custkey', 'c_custkey')} = p.c_custkey",
        [("0", 1.0), ("count_if(c_name = w_name)", 1.0), ("count(c_nationkey)", 1.0),
         ("count_if(c_acctbal = w_acctbal)", 2.0), ("count(c_mktsegment)", 1.0)])


def _precision_simple(from_sql: str, terms: list[tuple[str, float]]) -> str:
    aggs = ", ".join(f"({e})::DOUBLE AS e{i}" for i, (e, _) in enumerate(terms))
    total = " + ".join(f"{w}::DOUBLE * n" for _, w in terms)
    unchanged = " + ".join(f"{w}::DOUBLE * e{i}" for i, (_, w) in enumerate(terms))
    prec = f"CASE WHEN ({total}) = 0 THEN 100.0::DOUBLE ELSE ({unchanged}) / ({total}) * 100.0::DOUBLE END"
    return f"""WITH c AS (SELECT count(*)::DOUBLE AS n, {aggs} FROM ({from_sql}) q)
    SELECT {prec} AS precision_pct, 100.0::DOUBLE - {prec} AS privacy_pct FROM c"""


def _stats_sql_named(table_sql: str, cols: list[tuple[str, str]], digits: int = 6) -> str:
    parts = []
    for i, (c, typ) in enumerate(cols):
        if typ == "numeric":
            x = f"TRY_CAST({c} AS DOUBLE)"
            num = (f"round(avg({x}), {digits}) AS mean, round(min({x}), {digits}) AS min, round(max({x}), {digits}) AS max, "
                   f"round(stddev_samp({x}), {digits}) AS std, round(median({x}), {digits}) AS median")
        else:
            num = ("NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS std, "
                   "NULL::DOUBLE AS median")
        parts.append(f"SELECT {i} AS o, '{c}' AS \"column\", '{typ}' AS \"type\", count({c}) AS \"count\", "
                     f"count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS nulls, {num} FROM t")
    return (f"WITH t AS ({table_sql}) SELECT \"column\", \"type\", \"count\", unique_count, nulls, "
            f"mean, min, max, std, median FROM ({' UNION ALL '.join(parts)}) ORDER BY o")


def _lineitem_release_sql(round_quantity: bool = True) -> str:
    noise = _noise_sql("sha256('" + str(SEED) + "|l_quantity|' || " + _key_part("t.l_orderkey") + " || '|' || "
                       + _key_part("t.l_linenumber") + ")")
    qty = f"least(greatest(t.l_quantity + {noise} * f.eff, f.mn), f.mx)"
    if round_quantity:
        qty = f"round({qty}, 6)"
    return f"""WITH t AS (SELECT {', '.join(LINEITEM_COLS)} FROM lineitem),
    r AS (SELECT l_orderkey AS value, dense_rank() OVER (ORDER BY l_orderkey) AS rank FROM (SELECT DISTINCT l_orderkey FROM t)),
    m AS (SELECT min(l_quantity)::DOUBLE AS mn, max(l_quantity)::DOUBLE AS mx FROM t),
    f AS (SELECT mn, mx, (0.05::DOUBLE * CASE WHEN mx = mn THEN 1.0::DOUBLE ELSE mx - mn END) AS eff FROM m),
    {_bins_ctes('t', 'l_extendedprice', 20, True)[5:]}
    SELECT r.rank AS l_orderkey, t.l_partkey, {_token_sql('t.l_suppkey', 'l_suppkey')} AS l_suppkey, t.l_linenumber,
           {qty} AS l_quantity, b.mid AS l_extendedprice, t.l_discount, t.l_tax, t.l_returnflag, t.l_linestatus,
           {_mask_sql('mask_after_last_space', 'CAST(t.l_shipdate AS VARCHAR)')} AS l_shipdate,
           t.l_orderkey AS o_orderkey, t.l_suppkey AS o_suppkey, t.l_quantity AS o_quantity,
           t.l_extendedprice AS o_extendedprice, t.l_shipdate AS o_shipdate
    FROM t JOIN r ON t.l_orderkey = r.value CROSS JOIN f {_bin_join('t', 'l_extendedprice', True)}"""


def _own_oracles() -> dict[str, str]:
    cust_cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    cust_w = {"c_acctbal": 2.0}
    return {
        "release_pipeline": _pipeline_sql(),
        "pseudonym_seeded": f"SELECT c_custkey, {_token_sql('c_name', 'c_name')} AS c_name FROM customer",
        "pseudonym_nulls": f"SELECT o_orderkey, {_token_sql('o_custkey', 'o_custkey')} AS o_custkey FROM ({_ORDERS_NULL_CUST})",
        "pseudonym_keep_nulls": (f"SELECT o_orderkey, {_token_sql('o_custkey', 'o_custkey', keep_nulls=True)} AS o_custkey "
                                 f"FROM ({_ORDERS_NULL_CUST})"),
        "pseudonym_random_invariants": (
            "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS distinct_in, count(DISTINCT o_custkey) AS distinct_out, "
            "count(DISTINCT o_custkey) AS distinct_pairs, count(*) AS well_formed, count(*) AS differ_between_runs "
            "FROM orders"),
        "ope_int": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) AS o_custkey FROM orders",
        "ope_string": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) AS c_name FROM customer",
        "ope_nulls": (f"SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN NULL ELSE "
                      f"dense_rank() OVER (PARTITION BY o_custkey IS NULL ORDER BY o_custkey) END AS o_custkey "
                      f"FROM ({_ORDERS_NULL_CUST})"),
        "ope_mapping": "SELECT user_id AS value, dense_rank() OVER (ORDER BY user_id) AS rank FROM (SELECT DISTINCT user_id FROM events)",
        "ope_roundtrip": "SELECT event_id, user_id FROM events",
        "ope_reverse_forced": (
            "WITH m AS (SELECT user_id AS value, dense_rank() OVER (ORDER BY user_id) AS rank FROM (SELECT DISTINCT user_id FROM events)), "
            "g AS (" + _generalize_sql(
                "SELECT e.event_id, m.rank AS user_id FROM events e JOIN m ON e.user_id = m.value",
                ["event_id"], "user_id", 7, cast="BIGINT") + ") "
            "SELECT g.event_id, coalesce(m.value, g.user_id) AS user_id FROM g LEFT JOIN m ON g.user_id = m.rank"),
        "ope_reverse_passthrough": (
            "WITH m AS (SELECT user_id AS value, dense_rank() OVER (ORDER BY user_id) AS rank FROM (SELECT DISTINCT user_id FROM events)) "
            f"SELECT e.event_id, {_token_sql('m.rank', 'user_id')} AS user_id FROM events e JOIN m ON e.user_id = m.value"),
        "generalize_int": _generalize_sql("SELECT p_partkey, p_size FROM part", ["p_partkey"], "p_size", 10, cast="INTEGER"),
        "generalize_truncate": _generalize_sql("SELECT p_partkey, p_size FROM part", ["p_partkey"], "p_size", 10,
                                               cast="INTEGER", truncate=True),
        "generalize_float": _generalize_sql("SELECT c_custkey, c_acctbal FROM customer", ["c_custkey"], "c_acctbal", 10),
        "generalize_no_lowest": _generalize_sql("SELECT c_custkey, c_acctbal FROM customer", ["c_custkey"], "c_acctbal", 10,
                                                include_lowest=False),
        "ope_large_mapping": "SELECT dense_rank() OVER (ORDER BY event_id) AS event_id, user_id FROM events",
        "ope_hot_key": ("SELECT o_orderkey, dense_rank() OVER (ORDER BY k) AS o_custkey FROM (SELECT o_orderkey, "
                        "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS k FROM orders)"),
        "csv_short_rows": _SUPPLIER_HALF,
        "csv_schema_na": _SUPPLIER_HALF,
        "csv_multiline": (
            "SELECT o_orderkey, o_orderpriority || repeat(chr(10), (o_orderkey % 3)::INT) || '\"' || o_orderstatus || '\",' || "
            "CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '.' ELSE '.' END AS note, o_totalprice FROM orders"),
        "csv_multi_file": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
        "export_columns": "SELECT c_acctbal, c_custkey FROM customer",
        "generalize_fine_bins": _generalize_sql("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
                                                ["l_orderkey", "l_linenumber"], "l_extendedprice", 5000),
        "perturb_nonunique_identifier": ("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_identifiers, "
                                         "TRUE AS noise_by_row FROM orders"),
        "reset_working": "SELECT *, 0 AS n_mappings FROM customer",
        "preview_original": ("SELECT *, (SELECT count(*) FROM customer) AS n_total FROM customer "
                             "ORDER BY c_custkey LIMIT 15"),
        "stats_display": _rounded_sql(_stats_sql_named("SELECT * FROM customer", [
            ("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
            ("c_mktsegment", "categorical")]), 4),
        "stats_documents": _stats_sql_named("SELECT * FROM documents", [
            ("doc_id", "numeric"), ("text", "categorical"), ("lang", "categorical"), ("source", "categorical"),
            ("n_chars", "numeric")]),
        "precision_display": ("SELECT round(precision_pct, 1) AS precision_pct, round(privacy_pct, 1) AS privacy_pct FROM ("
                              + _pipeline_precision_sql() + ")"),
        "generalize_many_bins": _generalize_sql("SELECT c_custkey, c_acctbal FROM customer", ["c_custkey"], "c_acctbal", 200),
        "generalize_constant": _generalize_sql("SELECT p_partkey, greatest(p_size, 100)::DOUBLE AS v FROM part",
                                               ["p_partkey"], "v", 4),
        "generalize_nulls": _generalize_sql(f"SELECT c_custkey, c_acctbal FROM ({_CUSTOMER_NULL_BAL})", ["c_custkey"],
                                            "c_acctbal", 5),
        "perturb_seeded": _perturb_sql("events", "event_id", "value", 0.1, SEED, "event_id", None, _key_part("event_id")),
        "perturb_nulls": _perturb_sql(
            "(SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events)",
            "event_id", "value", 0.1, SEED, "event_id", None, _key_part("event_id")),
        "perturb_int": _perturb_sql("part", "p_partkey", "p_size", 0.2, SEED, "p_partkey", "INTEGER",
                                    _key_part("p_partkey")),
        "perturb_zero_noise": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
        "perturb_invariants": "SELECT count(*) AS n_rows, TRUE AS bounded, 0::BIGINT AS nulls FROM lineitem",
        "mask_first_k": f"SELECT doc_id, {_mask_sql('mask_first_k', 'text', 5)} AS text FROM documents",
        "mask_last_k": f"SELECT conv_id, turn, {_mask_sql('mask_last_k', 'text', 7)} AS text FROM conversations",
        "mask_before_space": f"SELECT doc_id, {_mask_sql('mask_before_first_space', 'text')} AS text FROM documents",
        "mask_after_space": f"SELECT conv_id, turn, {_mask_sql('mask_after_last_space', 'text')} AS text FROM conversations",
        "mask_regex": f"SELECT doc_id, {_mask_sql('mask_regex', 'text', pattern=chr(92) + 'p{Nd}+')} AS text FROM documents",
        "mask_regex_email": (f"SELECT doc_id, {_mask_sql('mask_regex', 'text', pattern='[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')}"
                             " AS text FROM documents"),
        "mask_pages_after_space": f"SELECT page_id, {_mask_sql('mask_after_last_space', 'html')} AS html FROM pages",
        "mask_pages_regex": f"SELECT page_id, {_mask_sql('mask_regex', 'html', pattern='[0-9]{3,}')} AS html FROM pages",
        "mask_numeric_column": f"SELECT c_name, {_mask_sql('mask_first_k', 'CAST(c_custkey AS VARCHAR)', 2)} AS c_custkey FROM customer",
        "precision_untouched": _precision_simple("SELECT * FROM customer",
                                                 [(f"count({c})", cust_w.get(c, 1.0)) for c in cust_cols]),
        "precision_pipeline": _pipeline_precision_sql(),
        "export_with_metric": _pipeline_precision_sql(),
        "precision_with_nulls": _precision_simple(_CUSTOMER_NULL_BAL,
                                                  [(f"count({c})", cust_w.get(c, 1.0)) for c in cust_cols]),
        "precision_type_change": _precision_simple(
            "SELECT c_custkey, dense_rank() OVER (ORDER BY c_custkey) AS w_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment "
            "FROM customer",
            [("count_if(c_custkey = w_custkey)", 1.0), ("count(c_name)", 1.0), ("0", 1.0),
             ("count(c_acctbal)", 2.0), ("count(c_mktsegment)", 1.0)]),
        "stats_original": _stats_sql_named(
            "SELECT * FROM events",
            [("event_id", "numeric"), ("ts", "categorical"), ("user_id", "numeric"), ("event_type", "categorical"),
             ("value", "numeric"), ("props", "categorical")]),
        "stats_working": _stats_sql_named(
            "WITH t0 AS (SELECT * FROM orders), " + _bins_ctes("t0", "o_totalprice", 8, True)[1:]
            + f" SELECT t0.o_orderkey, {_token_sql('t0.o_custkey', 'o_custkey')} AS o_custkey, t0.o_orderstatus, "
            f"b.mid AS o_totalprice, t0.o_orderdate, t0.o_orderpriority FROM t0 {_bin_join('t0', 'o_totalprice', True)}",
            [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
             ("o_totalprice", "numeric"), ("o_orderdate", "categorical"), ("o_orderpriority", "categorical")]),
        "stats_approx": (
            "SELECT \"column\", \"count\", nulls, mean, TRUE AS count_equal, TRUE AS unique_close, "
            "TRUE AS median_close, TRUE AS mean_close FROM ("
            + _stats_sql_named("SELECT * FROM orders",
                               [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
                                ("o_totalprice", "numeric"), ("o_orderdate", "categorical"),
                                ("o_orderpriority", "categorical")]) + ")"),
        "csv_roundtrip": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
        "precision_between_export": _precision_simple(
            f"WITH t AS (SELECT * FROM customer), {_bins_ctes('t', 'c_acctbal', 10, True)[5:]} "
            f"SELECT t.*, {_mask_sql('mask_last_k', 't.c_name', 4)} AS w_name, b.mid AS w_acctbal "
            f"FROM t {_bin_join('t', 'c_acctbal', True)}",
            [("count(c_custkey)", 1.0), ("count_if(c_name = w_name)", 1.0), ("count(c_nationkey)", 1.0),
             ("count_if(c_acctbal = w_acctbal)", 2.0), ("count(c_mktsegment)", 1.0)]),
        "bundle_roundtrip": _pipeline_sql(),
        "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 20",
        "preview_file_order": f"SELECT * EXCLUDE (position) FROM ({_ORDERED_SQL}) WHERE position < 40",
        "export_file_order": _ORDERED_SQL,
        "precision_by_position": _precision_simple(
            f"SELECT w.*, o.* FROM ({_ORDERED_SQL}) w JOIN (SELECT row_number() OVER () - 1 AS at, l_orderkey AS o_key, "
            "CAST(l_shipdate AS VARCHAR) AS o_date FROM lineitem) o ON o.at = w.position",
            [("count_if(l_orderkey = o_key)", 1.0), ("count(l_linenumber)", 1.0), ("count(l_extendedprice)", 2.0),
             ("count_if(l_shipdate = o_date)", 1.0)]),
        "stream_release": _pipeline_sql(),
        "lineitem_release": ("SELECT " + ", ".join(LINEITEM_COLS) + " FROM (" + _lineitem_release_sql() + ")"),
        "lineitem_precision": _precision_simple(
            _lineitem_release_sql(round_quantity=False),
            [("count_if(l_orderkey = o_orderkey)", 1.0), ("count(l_partkey)", 1.0), ("0", 1.0),
             ("count(l_linenumber)", 1.0), ("count_if(l_quantity = o_quantity)", 1.0),
             ("count_if(l_extendedprice = o_extendedprice)", 2.0), ("count(l_discount)", 1.0), ("count(l_tax)", 1.0),
             ("count(l_returnflag)", 1.0), ("count(l_linestatus)", 1.0), ("0", 1.0)]),
        "lineitem_stats": _stats_sql_named(
            "SELECT " + ", ".join(LINEITEM_COLS) + " FROM (" + _lineitem_release_sql(round_quantity=False) + ")",
            [(c, LINEITEM_META.declared_type(c)) for c in LINEITEM_COLS], 7),
        "stream_events": (
            "SELECT p.event_id, " + _token_sql("e.user_id", "user_id") + " AS user_id, p.value, "
            + _mask_sql("mask_regex", "e.props", pattern=chr(92) + "p{Nd}+") + " AS props FROM events e JOIN ("
            + _perturb_sql("events", "event_id", "value", 0.1, SEED, "event_id", None, _key_part("event_id"))
            + ") p ON e.event_id = p.event_id"),
        "sql_functions": (
            f"SELECT c_custkey, {_mask_sql('mask_first_k', 'c_name', 3)} AS first3, "
            f"{_mask_sql('mask_last_k', 'c_name', 4)} AS last4, "
            f"{_mask_sql('mask_before_first_space', 'c_mktsegment')} AS seg_before, "
            f"{_mask_sql('mask_after_last_space', 'c_mktsegment')} AS seg_after, "
            f"{_token_sql('c_nationkey', 'c_nationkey')} AS nation_token FROM customer"),
    }
