"""Corpus preparation in five stages: filter, deduplicate documents and passages, mix, tokenize.

Each stage takes the documents that the one before kept and returns documents again (the last one
returns tokens). ``run`` writes each stage's result to the shared scratch folder and reads it back, so a
stage is computed once and a lost executor costs at most the stage at hand. A stage's table is deleted
once the next one is written; the last one stays for the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veil.llm import bpe, minhash_odd, mixing, quality_gbdt, queries, sa_dedup
from veil.llm._common import fold
from veil.session import remove_tree, scratch_path


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it never learns from the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gbdt.accepted_documents(docs, quality_gbdt.fit(docs, labels, learn=fold("doc_id", 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash_odd.kept_documents(docs, width=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that the corpus holds twice or more."""
    return sa_dedup.dedup_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document of the mix."""
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", accept),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding", tokenize),
]

#: Trained trees, similarity classes and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_tree(spark, before)
        before = path
    return docs
