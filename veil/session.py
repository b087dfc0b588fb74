"""Session helpers: a local builder for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(master: str = "local[8]", app: str = "veil", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. Cluster jobs use the session they are given."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return None


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine (``local``, ``local[8]``)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only when nothing is configured and the master is ``local[...]`` (tests, local runs) is a local
    folder created: on a cluster each executor would write to its own disk, so there it is an error.
    A classic session's SparkContext is pointed at the folder so ``DataFrame.checkpoint()`` works too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not configured and sc is not None:
        configured = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc is None or not is_local(sc.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        configured = tempfile.mkdtemp(prefix="veil-ckpt-")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/veil-{name}-{uuid.uuid4().hex}"


def scratch_root(file: str) -> str | None:
    """The scratch folder (a path that ``scratch_path`` made) above a file, if there is one."""
    m = re.match(r"(.*/veil-[^/]*-[0-9a-f]{32})/", unquote(file))
    return m[1] if m else None


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder on whatever file system it is; a local one without the JVM."""
    local = local_path(re.sub(r"^file:/+", "file:/", path))
    if local is not None:
        shutil.rmtree(local, ignore_errors=True)
        return
    sc = _context(spark)
    if sc is not None:  # remote file systems are reached through Hadoop
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``, whatever file system it is on; none if there is no such folder."""
    local = local_path(re.sub(r"^file:/+", "file:/", path))
    if local is not None:
        return [e.name for e in os.scandir(local) if e.is_dir()] if os.path.isdir(local) else []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []


def local_path(path: str) -> str | None:
    """The local filesystem path behind ``path`` if it is a local path, else None."""
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        return None
    return os.path.abspath(path)
