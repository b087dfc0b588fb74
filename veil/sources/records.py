"""CSV records whose quoted fields span lines, read by many tasks from one file.

A line goes on in the next one if the quotes before its end, counted from the start of the file, are odd in
number. Each task reads its blocks of a file as lines; the number of quotes in earlier blocks is a
running sum over a table of one row a block, the number within a block a running sum over its lines.
So every line knows whether it begins a record. Lines that are records by themselves are parsed where
they are; only those of records over several lines meet by (file, record) to be joined. The fields are
parsed by Spark's own CSV functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTF8 = ("utf-8", "utf8")


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def applies(opts: dict) -> bool:
    """Whether lines can be read one by one: UTF-8, lines that end in a line feed, one-character quotes."""
    encoding = str(opts.get("encoding", opts.get("charset", "utf-8"))).lower()
    return encoding in UTF8 and "lineSep" not in opts and len(opts["quote"]) == 1 and "comment" not in opts


def lines_of(spark: SparkSession, path: str, opts: dict) -> DataFrame:
    """file, block, at (order within the block), line and odd (1 if its quotes are odd in number)."""
    quote, escape = opts["quote"], opts["escape"]
    kept = F.col("value") if escape == quote else F.regexp_replace("value", literal(escape) + "(?s:.)", "")
    odd = (F.length(F.regexp_replace(kept, f"[^{literal(quote)}]", "")) % 2).cast("long")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), odd.alias("odd"))


def spans_lines(spark: SparkSession, path: str, opts: dict) -> bool:
    """Whether any quoted field of the files goes on in another line; one that never ends raises."""
    per = lines_of(spark, path, opts).groupBy("file").agg(F.sum("odd").alias("n"))
    found = per.agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") % 2 == 1, F.col("file"))).alias("open")).first()
    if found["open"]:
        raise ValueError(f"CSV '{found['open']}': a quoted field never ends.")
    return bool(found["n"])


def records(spark: SparkSession, path: str, opts: dict) -> DataFrame:
    """file, number (0 is the header) and text of every record."""
    of_block = Window.partitionBy("file", "block").orderBy("at")
    rows = lines_of(spark, path, opts).withColumn(
        "odds", F.coalesce(F.sum("odd").over(of_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    even = F.col("odds") % 2 == 0  # begins a record if the quotes before the block are even in number
    rows = rows.withColumn("evens", F.sum(even.cast("long")).over(of_block.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "lines", F.row_number().over(of_block).cast("long"))
    blocks = rows.groupBy("file", "block").agg(
        F.sum("odd").alias("quotes"), F.max("evens").alias("evens"), F.max("lines").alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("enters", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("enters") == 0, F.col("evens")).otherwise(F.col("lines") - F.col("evens"))
    blocks = blocks.withColumn("begun", begun).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "enters",
        F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    rows = rows.join(blocks, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    begins = (F.col("odds") + F.col("enters")) % 2 == 0
    begun = F.when(F.col("enters") == 0, F.col("evens")).otherwise(F.col("lines") - F.col("evens"))
    rows = rows.select("file", "block", "at", "line", (begins & (F.col("odd") == 0)).alias("whole"),
                       (F.col("earlier") + begun - 1).alias("number"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    joined = rows.where("NOT whole").groupBy("file", "number").agg(parts.alias("parts")).select(
        "file", "number", F.array_join(F.transform("parts", lambda p: p.getField("line")), "\n").alias("text"))
    return rows.where("whole").select("file", "number", F.col("line").alias("text")).unionByName(joined).select(
        "file", "number", F.regexp_replace("text", "\r$", "").alias("text"))


def parsed(spark: SparkSession, path: str, names: list[str], opts: dict, corrupt: str) -> DataFrame:
    """The fields of every record but the headers as text, with the raw record under ``corrupt`` where the number of
    fields differs; every file's header is compared with ``names``."""
    schema = T.StructType([*[T.StructField(n, T.StringType(), True) for n in names],
                           T.StructField(corrupt, T.StringType(), True)])
    reader = {k: v for k, v in opts.items() if k not in ("header", "inferSchema", "enforceSchema")}
    reader |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "multiLine": "true"}
    rows = records(spark, path, opts).where("text <> ''")
    values = F.from_csv("text", _ddl(schema), reader)
    rows = rows.select("number", values.alias("v"), "file")
    head = F.array(*[F.coalesce(F.col("v")[n], F.lit("")) for n in names])
    differs = (head != F.array(*[F.lit(n) for n in names])) | F.col("v")[corrupt].isNotNull()
    wrong = F.raise_error(F.concat(F.lit("CSV '"), F.col("file"), F.lit(f"': the header is not {names}."))).cast("boolean")
    kept = F.when(F.col("number") > 0, F.lit(True)).when(differs, wrong).otherwise(F.lit(False))
    return rows.where(kept).select("v.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
