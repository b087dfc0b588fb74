"""Merkle manifest of a dataset with inclusion proofs by pointer jumping.

Each row is a leaf, the SHA-256 of its fields. The leaves of a source, ordered by doc_id, form a tree of
runs of ``FAN`` nodes; the roots of the sources, ordered by source, form another one. Places come from a
distributed sort, runs from one grouping by (source, place / FAN), never more than ``FAN`` nodes a group,
so a source of any size spreads over all tasks; every further level has a sixteenth of the rows.

Proofs: each inner node holds a pointer to an ancestor and the segment of siblings (left, right) on the
way there, at first to its parent. A round joins the pointers with themselves: the ancestor's segment
is appended and the distance doubles, until every pointer stands at the root. After r rounds an ancestor
is the target of at most FAN ** (2 ** r) pointers, and so few targets are left when that is much that
they are broadcast (their number is counted first). The leaves of a run share everything above it, so
only runs take part; each leaf reads its own siblings off its run in the end.

Everything is DataFrame functions. Defined results: a null field is written ``-``, so it differs from
an empty one; a null source is a source and comes first; null ids come first in their source; rows with the
same id are ordered by their digest, and equal rows follow each other; texts are hashed whole; a source of
one row has its leaf as root; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.places import bounded, with_places
from veil.session import ensure_checkpoint_dir

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Pointer targets (some KB each) up to which a round broadcasts them.
BROADCAST_TARGETS = 2048

_PATH = "array<struct<l: string, r: string>>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field its UTF-8 length, a colon and its value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, path: Column) -> Column:
    """The digest at the end of a path of siblings."""
    return F.aggregate(path, start, lambda h, s: digest(s.getField("l"), h, s.getField("r")))


def _others(digests: Column, i: Column) -> Column:
    """What stands left and right of number ``i`` (from 0) among a run's digests."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("l"),
                    F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("r"))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the hex digits of n - 1 (a run is sixteen)."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.hex(n - 1))).cast("int")


def _runs(nodes: DataFrame, name: str, level: int, kid: list[str], of_tree: tuple[str, ...] = ("tree", "n")) -> DataFrame:
    """One row for each run of nodes (columns place, ``kid`` and ``of_tree``): its node name and its kids in order."""
    kids = F.array_sort(F.collect_list(F.struct("place", *kid))).alias("kids")
    return nodes.groupBy(*of_tree, F.floor(F.col("place") / FAN).alias("run")).agg(kids).withColumn(
        "node", F.concat_ws("/", F.lit(name), F.lit(level), "tree", "run"))


def _grow(nodes: DataFrame, name: str, level: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (tree, place, n, node, digest), none wider than ``most``: root of each, pointers of the rest."""
    roots = nodes.where("n = 1").select("tree", "node", "digest")
    pointers = None
    while most > 1:
        level += 1
        runs = _runs(nodes.where("n > 1"), name, level, ["node", "digest"])
        runs = runs.withColumn("digest", digest(F.array_join("kids.digest", ""))).checkpoint()
        up = runs.select("kids", F.col("node").alias("up"), F.posexplode("kids").alias("i", "kid")).select(
            F.col("kid.node").alias("node"), "up", F.array(_others(F.col("kids.digest"), F.col("i"))).alias("path"))
        pointers = up if pointers is None else pointers.unionByName(up)
        nodes = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), "node", "digest")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "node", "digest"))
        most = math.ceil(most / FAN)
    if pointers is None:
        pointers = roots.where(F.lit(False)).select("node", F.col("node").alias("up"), F.array().cast(_PATH).alias("path"))
    return roots, pointers


def jump(pointers: DataFrame, root: str, height: int) -> DataFrame:
    """Pointers (node, up, path) drawn out to the root: each round doubles how far they reach."""
    pointers = pointers.checkpoint()
    for _ in range(math.ceil(math.log2(max(height, 1)))):
        met = pointers.where(F.col("up") != root).select(F.col("up").alias("node")).distinct()
        targets = pointers.join(met, "node", "left_semi").select(
            F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path")).checkpoint()
        pointers = pointers.join(bounded(targets, BROADCAST_TARGETS), F.col("up") == F.col("_node"), "left").select(
            "node", F.coalesce("_up", "up").alias("up"),
            F.concat("path", F.coalesce("_path", F.array().cast(_PATH))).alias("path")).checkpoint()
    return pointers


def proofs(df: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, source, leaf, claimed, subroot, root and path (siblings left and right, level by level) of every row.

    ``claimed`` is a leaf to be checked later against the path, over the columns of ``df``; where it is null
    or not given, it is the row's own.
    """
    ensure_checkpoint_dir(df.sparkSession)
    own = leaf([F.col(c) for c in fields])
    leaves = df.select("doc_id", F.col("source").cast("string").alias("source"), own.alias("leaf"),
                       (F.lit(None).cast("string") if claimed is None else claimed).alias("other")).checkpoint()
    sources = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    kind = leaves.schema["doc_id"].dataType.simpleString()
    sizes = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("sources")).first()
    if not sizes["sources"]:
        return df.sparkSession.createDataFrame(
            [], f"doc_id {kind}, source string, leaf string, claimed string, subroot string, root string, path {_PATH}")
    numbered = with_places(sources.select("source"), [F.col("source").asc_nulls_first()]).select(
        "source", F.col("place").alias("tree"))
    rows = with_places(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "source", numbered)
    runs = _runs(rows.withColumnRenamed("group_rows", "n"), "s", 1, ["doc_id", "leaf", "other"],
                 ("tree", "n", "source"))
    alone = F.col("n") == 1  # its leaf is the root of the source
    runs = runs.withColumn("digest", F.when(alone, F.element_at("kids", 1)["leaf"]).otherwise(
        digest(F.array_join("kids.leaf", "")))).checkpoint()
    nodes = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), "node", "digest")
    most, count = sizes["most"], sizes["sources"]
    subroots, low = _grow(nodes, "s", 1, math.ceil(most / FAN))
    tops = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), F.lit(count).cast("long").alias("n"),
                           "node", "digest")
    roots, high = _grow(tops, "t", 0, count)
    root = roots.first()
    height = len(f"{max(most - 1, 1):x}") + len(f"{max(count - 1, 1):x}")
    pointers = jump(low.unionByName(high), root["node"], height).select(F.col("node").alias("_node"), "path")
    above = runs.join(pointers, F.col("node") == F.col("_node"), "left").select(
        "kids", "n", "source", F.coalesce("path", F.array().cast(_PATH)).alias("above"), "digest")
    # the source's own levels come first on the way up
    above = above.withColumn("subroot", fold(F.col("digest"), F.slice(
        "above", F.lit(1), F.greatest(_height(F.col("n")) - 1, F.lit(0)))))
    return above.select("*", F.posexplode("kids").alias("i", "kid")).select(
        F.col("kid.doc_id").alias("doc_id"), "source", F.col("kid.leaf").alias("leaf"),
        F.coalesce("kid.other", "kid.leaf").alias("claimed"), "subroot", F.lit(root["digest"]).alias("root"),
        F.when(alone, F.col("above")).otherwise(
            F.concat(F.array(_others(F.col("kids.leaf"), F.col("i"))), F.col("above"))).alias("path"))


def manifest(df: DataFrame) -> DataFrame:
    """source, rows, subroot and root: what a dataset's publisher hands out."""
    return proofs(df).groupBy("source", "subroot", "root").agg(F.count(F.lit(1)).alias("rows"))


def verified_documents(df: DataFrame, tamper_modulus: int = 5) -> DataFrame:
    """Proof digests of every row, checked after rows whose id's CRC ``tamper_modulus`` divides were altered."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_modulus == 0
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())
    other = leaf([lowered if c == "text" else F.col(c) for c in FIELDS])
    rows = proofs(df, F.when(tampered, other))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.getField("l"), s.getField("r"))), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
        fold(F.col("claimed"), F.col("path")).alias("folded_root")).withColumn(
            "verified", F.col("folded_root") == F.col("root"))
