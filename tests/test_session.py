import pytest

from veil.session import is_local, remove_tree, scratch_path, scratch_root


def test_only_local_masters_may_use_a_local_folder():
    assert is_local("local") and is_local("local[4]") and is_local("local[*]")
    assert not any(is_local(m) for m in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://x"))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from veil import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

    class Session:
        conf = Context()

    monkeypatch.setattr(session, "_context", lambda s: Context())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_statistics_leave_no_scratch_behind(spark):
    import glob

    from veil import Metadata, Release
    from veil.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).replace("file:", "")
    df = spark.createDataFrame([(i, f"name {i % 7}") for i in range(100)], "a long, b string")
    before = set(glob.glob(f"{base}/veil-stats*"))
    Release(df, Metadata({"a": "numeric", "b": "categorical"})).statistics().collect()
    assert set(glob.glob(f"{base}/veil-stats*")) == before


def test_scratch_folders_are_recognised(spark):
    path = scratch_path(spark, "try")
    spark.range(3).write.parquet(path)
    files = spark.read.parquet(path).inputFiles()
    assert {scratch_root(f) for f in files} != {None}
    for f in files:
        remove_tree(spark, scratch_root(f))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_close_deletes_the_reversal_key(spark, scratch):
    import os

    from veil import Metadata, Release

    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "a long, b string")
    r = Release(df, Metadata({}, identifiers=["b"])).order_preserving_pseudonyms()
    folders = {scratch_root(f).replace("file:", "") for f in r.mapping("b").inputFiles()}
    assert folders and all(os.path.isdir(f.replace("//", "/")) for f in folders)
    path = scratch("kept")
    r.save(path)
    r.close()
    assert not any(os.path.isdir(f.replace("//", "/")) for f in folders)
    back = Release.load(spark, path)
    back.close()  # a bundle keeps its mapping
    assert Release.load(spark, path).reverse_pseudonyms().working().exceptAll(df).count() == 0
