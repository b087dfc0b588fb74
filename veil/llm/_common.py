"""Helpers shared by the text operators: column access, bounded text batches, stable sampling."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veil.session import remove_tree, scratch_path

#: A word: a maximal run without ASCII white space (``bytes.split()`` cuts at the same characters).
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a Python worker handles at once, and where its arrays are many times the text.
BATCH_BYTES, SMALL_BYTES = 4 << 20, 1 << 20


def documents(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; any other column, whatever its name, is left behind."""
    return df.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batch: pa.RecordBatch, column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def give_back(run: Callable) -> Callable:
    """``run`` over a task's batches, after which its Python worker hands freed memory back to the system.

    Workers are kept for the tasks of later stages; otherwise each would hold on to the most that any of them took.
    """
    def whole(batches):
        yield from run(batches)
        _release()

    return whole


def map_documents(df: DataFrame, make: Callable[[], Callable], schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """Apply a function of (ids, texts) to bounded pieces of every partition, without a shuffle.

    ``make()`` runs once a task and returns the function; it gets the pyarrow array of ids and a
    list of texts (None for null) and returns the output columns as arrays, in schema order.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        fn = make()
        for batch in batches:
            for piece in slices(batch, 1, most):
                columns = fn(piece.column(0), piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                     for c, f in zip(columns, out)], schema=out)

    return documents(df).mapInArrow(give_back(run), schema)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose key hashes lowest: stable between runs and partitionings."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)


def numbered_copies(df: DataFrame, n: str, number: str = "copy", chunk: int = 4096, deal: bool = False) -> DataFrame:
    """Every row as often as column ``n`` says, numbered from 0 in ``number``. Numbers are made ``chunk`` at a time,
    so no row becomes one long array; ``deal`` sends the chunks to different tasks first."""
    first = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))
    rows = df.where(F.col(n) > 0).withColumn("_chunk", F.explode(first))
    rows = rows.repartition(*rows.columns) if deal else rows
    begin = F.col("_chunk") * chunk
    return rows.withColumn(number, F.explode(F.sequence(begin, F.least(F.col(n), begin + chunk) - 1))).drop("_chunk")


def one_text_an_id(df: DataFrame, *also: str) -> DataFrame:
    """(doc_id, also..., text) with one row for each doc_id: the smallest text. Bounds by ids a sample whose rows are
    joined by doc_id, however often the table repeats one."""
    return df.groupBy("doc_id", *also).agg(F.min("text").alias("text"))


def utf8(texts: list[str | None]) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and where each blob begins (one entry more than blobs)."""
    starts = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) for b in blobs], out=starts[1:])
    return np.frombuffer(b"".join(blobs), np.uint8), starts


class Scratch:
    """Tables written to the shared scratch folder and read back: they cut lineage, give the optimizer their size,
    and can be deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = back, path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (t, None))
            if path:
                remove_tree(self.spark, path)
