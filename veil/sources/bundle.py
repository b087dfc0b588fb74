"""Save / load a release as a bundle directory on any Spark-supported filesystem.

Layout: ``<path>/v<time>-<id>/frame`` (paired parquet: working + original of changed columns),
``.../mapping-<i>`` (one parquet per rank mapping) and ``.../_release`` (JSON, written last; a
version without it is incomplete and ignored). Each save adds a new version folder, so saving a
release that was loaded from the same path never deletes the files it is still reading. ``keep=n`` deletes all but
the newest n complete versions once the new one is written. Loading lists the versions by name, newest first, and reads
the manifest of the newest complete one only. All data goes through Spark readers and writers.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .._util import local_frame, orig_name, qcol
from ..errors import LoadError
from ..metadata import Metadata
from ..operators.positions import PLACE
from ..plans.ranking import RankTable
from ..session import folder_names, remove_tree

FORMAT = "veil-release"
FORMAT_VERSION = 1
_VERSION = re.compile(r"v\d{20}-[0-9a-f]{8}")


def save(release, path: str, keep: int | None = None) -> str:
    """Add a version and return its folder. ``keep`` must leave room for the version a release still reads."""
    from ..plans.release import Release  # noqa: F401 - type only

    if keep is not None and (not isinstance(keep, int) or keep < 1):
        raise ValueError("keep must be a positive integer.")
    spark = release.frame.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    base = f"{path.rstrip('/')}/{version}"
    s = release._s
    s.frame.write.mode("errorifexists").parquet(f"{base}/frame")
    mappings = []
    for i, (c, m) in enumerate(s.mappings.items()):
        m.ranks.data.write.mode("errorifexists").parquet(f"{base}/mapping-{i}")
        hot = None
        if m.ranks.hot is not None:
            hot = f"mapping-{i}-hot"
            m.ranks.hot.write.mode("errorifexists").parquet(f"{base}/{hot}")
        mappings.append({"column": c, "dir": f"mapping-{i}", "hot": hot, "original_type": m.original_type.json(),
                         "version": m.version, "rows": m.ranks.rows, "bytes": m.ranks.bytes,
                         "from_original": m.from_original})
    meta = {
        "format": FORMAT, "format_version": FORMAT_VERSION, "version": version,
        "columns": list(s.columns), "metadata": s.metadata.to_dict(), "versions": s.versions,
        "mappings": mappings,
    }
    text = T.StructType([T.StructField("value", T.StringType())])
    local_frame(spark, [(json.dumps(meta),)], text).coalesce(1).write.text(f"{base}/_release")
    if keep is not None:
        prune(spark, path, keep)
    return base


def versions_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions under ``path``, newest first (names begin with the time, at full width)."""
    return sorted((n for n in folder_names(spark, path.rstrip("/")) if _VERSION.fullmatch(n)), reverse=True)


def prune(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete versions older than the newest ``keep`` complete ones; returns their names. Incomplete ones that are newer
    stay: they may be in the middle of being written."""
    left, gone = keep, []
    for v in versions_of(spark, path):
        if not left:
            remove_tree(spark, f"{path.rstrip('/')}/{v}")
            gone.append(v)
        elif _manifest(spark, f"{path.rstrip('/')}/{v}") is not None:
            left -= 1
    return gone


def _manifest(spark: SparkSession, base: str) -> dict | None:
    """The version's JSON document; None if it is incomplete or isn't of this format."""
    try:
        m = json.loads("\n".join(r["value"] for r in spark.read.text(f"{base}/_release").limit(2).collect()))
    except (PySparkException, TypeError, ValueError):
        return None
    return m if isinstance(m, dict) and m.get("format") == FORMAT else None


def _fail(msg: str, cause: Exception | None = None):
    raise LoadError(f"Cannot load release: {msg}") from cause


def load(spark: SparkSession, path: str):
    from ..plans.release import RankMapping, Release, _State

    root = path.rstrip("/")
    found = versions_of(spark, root)
    if not found:
        _fail(f"no bundle at '{path}'")
    meta = next((m for m in (_manifest(spark, f"{root}/{v}") for v in found) if m is not None), None)
    if meta is None:
        _fail(f"'{path}' holds no complete bundle")
    if meta.get("format_version") != FORMAT_VERSION:
        _fail(f"unsupported bundle format version {meta.get('format_version')}")
    base = f"{root}/{meta['version']}"
    try:
        metadata = Metadata.from_dict(meta["metadata"])
        columns = list(meta["columns"])
        versions = {k: int(v) for k, v in meta["versions"].items()}
        frame = spark.read.parquet(f"{base}/frame")
        mappings = {}
        for m in meta["mappings"]:
            table = spark.read.parquet(f"{base}/{m['dir']}")
            hot = spark.read.parquet(f"{base}/{m['hot']}") if m.get("hot") else None
            ranks = RankTable(table, int(m["rows"]), int(m["bytes"]), hot)
            mappings[m["column"]] = RankMapping(ranks, T.StructType.fromJson({"fields": [{"name": "v", "type": json.loads(m["original_type"]), "nullable": True, "metadata": {}}]})["v"].dataType, m["version"],
                                                bool(m.get("from_original", False)))
    except (PySparkException, KeyError, TypeError, ValueError) as e:
        _fail(f"bundle '{base}' is incomplete or corrupt", e)
    places = PLACE if set(PLACE) <= set(frame.columns) else ()  # kept file order
    expected = set(columns) | {orig_name(c) for c in versions} | set(places)
    if set(frame.columns) != expected:
        _fail(f"bundle '{base}' frame columns do not match its metadata")
    try:
        metadata.validate(columns)
    except ValueError as e:
        _fail(f"the saved metadata names columns that the data lacks: {e}", e)
    source = frame.select(*[(qcol(orig_name(c)) if c in versions else qcol(c)).alias(c) for c in columns],
                          *places)
    return Release._from_state(_State(source, frame, metadata, tuple(columns), versions, mappings))
