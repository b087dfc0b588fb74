"""Rows by file order: dense positions, previews, exports and the metric."""

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veil import Metadata, Release, read_csv
from veil.operators.metrics import precision_privacy_by_position
from veil.operators.positions import PLACE, with_places, with_position

MD = Metadata(column_types={"id": "numeric", "v": "numeric", "s": "categorical"},
              identifiers=["id"], quasi_identifiers=["s"], sensitive_attributes=["v"])


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _table(n: int) -> pd.DataFrame:
    rng = np.random.default_rng(n)
    v = rng.integers(0, 50, n).astype(float)
    v[::7] = np.nan
    return pd.DataFrame({"id": rng.permutation(n) // 3, "v": v, "s": [f"{'same' if i % 3 else i} x" for i in range(n)]})


def _write(pdf: pd.DataFrame, folder: str, kind: str, sizes=(5, 3000, 0, 40, 900)) -> str:
    """Files of very different size, names in row order; a read packs them by size."""
    import os

    os.makedirs(folder, exist_ok=True)
    at = 0
    for i, n in enumerate([*sizes, len(pdf) - sum(sizes)]):
        part = pdf.iloc[at:at + n]
        at += n
        if kind == "csv":
            part.to_csv(f"{folder}/f{i}.csv", index=False)
        else:
            part.to_parquet(f"{folder}/f{i}.parquet", index=False, row_group_size=256)
    return folder


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_positions_follow_the_files(spark, scratch, small_splits, kind):
    pdf = _table(6000)
    path = _write(pdf, scratch(f"pos-{kind}"), kind)
    df = read_csv(spark, path, MD) if kind == "csv" else spark.read.parquet(path)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    got = with_position(df).toPandas().sort_values("position").reset_index(drop=True)
    assert got.position.tolist() == list(range(len(pdf)))
    assert got.id.tolist() == pdf.id.tolist() and got.s.tolist() == pdf.s.tolist()
    assert np.array_equal(got.v.astype(float), pdf.v, equal_nan=True)


def test_places_need_a_plain_read(spark, scratch):
    df = spark.read.parquet(_write(_table(4000), scratch("plain"), "parquet"))
    for other in (df.where("id > 3"), df.union(df), df.limit(3), spark.range(3), df.join(df.select("id"), "id")):
        with pytest.raises(ValueError, match="file order"):
            with_places(other)
    with pytest.raises(ValueError, match="reserved"):
        with_places(df.withColumnRenamed("v", PLACE[0].upper()))
    with pytest.raises(ValueError, match="already"):
        with_position(df, "ID")


def test_empty_table_has_no_positions(spark, scratch):
    path = scratch("none")
    spark.range(0).write.parquet(path)
    assert with_position(spark.read.parquet(path)).collect() == []


def test_preview_export_and_bundle_in_file_order(spark, scratch, small_splits):
    pdf = _table(6000)
    path = _write(pdf, scratch("order"), "csv")
    r = Release(read_csv(spark, path, MD), MD, file_order=True)
    assert r.columns == ["id", "v", "s"] and r.original().columns == r.working().columns == r.columns
    w = r.order_preserving_pseudonyms("id").mask("s", "mask_first_k", k=1)  # a join lies between file and preview
    want = pd.DataFrame({"id": pdf.id.rank(method="dense").astype(int), "s": ["*" + s[1:] for s in pdf.s]})
    for release in (w, w.checkpoint(), Release.load(spark, w.save(scratch("saved")).rsplit("/", 1)[0])):
        got = release.preview(700)
        assert [tuple(x) for x in got.select("id", "s").collect()] == list(want.head(700).itertuples(index=False, name=None))
        assert [x.s for x in release.preview(9, use_working=False).collect()] == pdf.s.head(9).tolist()
        assert release.reset().in_file_order
    out = scratch("out")
    w.export_csv(out)
    parts = [pd.read_csv(p, dtype={"s": str}) for p in sorted(glob.glob(f"{out}/part-*"))]
    back = pd.concat(parts, ignore_index=True)
    assert len(parts) > 1 and back.id.tolist() == want.id.tolist() and back.s.tolist() == want.s.tolist()


def test_release_without_file_order_is_as_before(spark, scratch):
    df = spark.read.parquet(_write(_table(4000), scratch("asis"), "parquet"))
    r = Release(df, MD)
    assert not r.in_file_order and set(r.frame.columns) == {"id", "v", "s"}
    assert r.preview(3, order_by=["s", "id"]).count() == 3


def test_metric_by_position_equals_row_by_row(spark, scratch, small_splits):
    pdf = _table(6000)  # ids and rows repeat: no key would align these tables
    other = pdf.copy()
    other.loc[::5, "v"] += 1
    other.loc[1::4, "s"] = "same x"
    a = spark.read.parquet(_write(pdf, scratch("a"), "parquet"))
    b = read_csv(spark, _write(other, scratch("b"), "csv", sizes=(2500, 1)), MD)
    got = precision_privacy_by_position(a, b, MD).first()
    unchanged = (pdf.id == other.id).sum() + 2 * (pdf.v == other.v).sum() + (pdf.s == other.s).sum()
    assert got.precision_pct == pytest.approx(unchanged / (4 * len(pdf)) * 100, abs=1e-12)
    assert got.privacy_pct == pytest.approx(100 - got.precision_pct, abs=1e-12)
    short = spark.read.parquet(_write(pdf.head(5999), scratch("short"), "parquet"))
    for wrong in (short, a.select("v", "id", "s")):
        with pytest.raises(ValueError, match="cannot be paired"):
            precision_privacy_by_position(a, wrong, MD)
