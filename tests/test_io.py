import os

import pytest
from pyspark.sql import functions as F

from veil import LoadError, Metadata, Release, read_csv
from veil.session import local_path

DIRTY = "id,zip,day,x\n1,01234,2024-01-01,NA\n2,09999,2024-01-02,3.5\n3,,2024-01-03,n/a\n"
DIRTY_META = Metadata({"zip": "categorical", "day": "categorical", "id": "numeric", "x": "numeric"})


def _write(scratch, text, name="in.csv"):
    d = local_path(scratch("csv-in"))
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_dirty_csv(spark, scratch):
    df = read_csv(spark, _write(scratch, DIRTY), DIRTY_META)
    assert dict(df.dtypes) == {"id": "bigint", "zip": "string", "day": "string", "x": "double"}
    rows = df.orderBy("id").collect()
    assert [r["zip"] for r in rows] == ["01234", "09999", None]
    assert [r["x"] for r in rows] == [None, 3.5, None]


def test_inference_without_declaration(spark, scratch):
    df = read_csv(spark, _write(scratch, "a,b,c,d\n1,1.5,True,x\n2,,false,y\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "", "id,x\nabc,1\n"])
def test_bad_csv(spark, scratch, text):
    with pytest.raises(ValueError):
        read_csv(spark, _write(scratch, text), Metadata({"id": "numeric"}) if "id" in text else None)


def test_export_and_reread(spark, scratch, staff):
    df, md = staff
    out = scratch("export")
    r = Release(df, md).generalize("years", 10).mask("team", "mask_last_k", k=3)
    r.export_csv(out)
    back = read_csv(spark, out, md)
    assert back.columns == ["badge", "years", "office", "team"]  # no index, no hidden columns
    assert back.count() == 150
    assert back.exceptAll(r.working()).count() == 0


def test_export_refuses_own_input(spark, scratch):
    out = scratch("self")
    spark.range(5).write.parquet(out)
    src = spark.read.parquet(out)
    with pytest.raises(ValueError):
        Release(src, Metadata({})).export_csv(out)
    with pytest.raises(ValueError):
        Release(src, Metadata({})).export_csv(out, index=True)


def test_bundle_roundtrip_and_resave(spark, scratch, staff):
    df, md = staff
    path = scratch("bundle")
    r = Release(df, md).order_preserving_pseudonyms().generalize("years", 5)
    r.save(path)
    loaded = Release.load(spark, path)
    assert loaded.metadata == md
    assert loaded.ope_mapping_columns == ["badge"]
    assert loaded.working().exceptAll(r.working()).count() == 0
    assert loaded.original().exceptAll(df).count() == 0
    assert loaded.compute_precision_privacy_tradeoff() == r.compute_precision_privacy_tradeoff()
    # load -> edit -> save under the same name must not destroy its own input
    edited = loaded.reverse_pseudonyms()
    edited.save(path)
    again = Release.load(spark, path)
    assert again.ope_mapping_columns == []
    assert sorted(x["badge"] for x in again.working().collect()) == list(range(1, 151))


def test_bundle_keeps_the_newest_complete_versions(spark, scratch, staff):
    from veil.sources import bundle

    df, md = staff
    path = scratch("versions")
    r = Release(df, md)
    names = [r.save(path).rsplit("/", 1)[1] for _ in range(2)]
    os.makedirs(f"{path}/v{'9' * 20}-{'0' * 8}/frame")  # being written: neither loaded nor deleted
    last = r.generalize("years", 5)
    names.append(last.save(path, keep=2).rsplit("/", 1)[1])
    assert bundle.versions_of(spark, path) == [f"v{'9' * 20}-{'0' * 8}", names[2], names[1]]
    assert Release.load(spark, path).changed_columns == ["years"]
    assert bundle.prune(spark, path, 1) == [names[1]]
    assert Release.load(spark, path).working().exceptAll(last.working()).count() == 0
    with pytest.raises(ValueError, match="keep"):
        r.save(path, keep=0)


@pytest.mark.parametrize("file_order", [False, True])
def test_metric_counted_while_exporting(spark, scratch, staff, file_order):
    df, md = staff
    source = scratch("measured-in")
    df.withColumn("years", F.when(F.col("badge") % 3 > 0, F.col("years"))).write.parquet(source)
    r = (Release(spark.read.parquet(source), md, file_order=file_order).order_preserving_pseudonyms()
         .generalize("years", 5).random_pseudonyms("badge").mask("office", "mask_first_k", k=1))  # number to text
    out = scratch("measured-out")
    got = r.export_with_metric(out).first()
    assert (got.precision_pct, got.privacy_pct) == r.compute_precision_privacy_tradeoff()
    assert 0 < got.precision_pct < 100 and read_csv(spark, out).count() == 150
    none = Release(spark.read.parquet(source).where("badge < 0"), md).export_with_metric(scratch("measured-none")).first()
    assert (none.precision_pct, none.privacy_pct) == (100.0, 0.0)


def test_load_errors(spark, scratch):
    with pytest.raises(LoadError):
        Release.load(spark, scratch("missing"))
    foreign = scratch("foreign")
    spark.range(3).write.parquet(foreign)
    with pytest.raises(LoadError):
        Release.load(spark, foreign)
    truncated = scratch("truncated")
    spark.createDataFrame([("{not json",)], "value string").write.text(f"{truncated}/v1/_release")
    with pytest.raises(LoadError):
        Release.load(spark, truncated)


def test_preview(staff):
    df, md = staff
    r = Release(df, md)
    assert [x["badge"] for x in r.preview(5, order_by=["badge"]).collect()] == [1, 2, 3, 4, 5]
    assert r.count() == 150
    with pytest.raises(ValueError):
        r.preview(0)


def test_csv_values_equal_pandas(spark, scratch):
    import pandas as pd

    text = "a,b,c,d,e\n1,1.5,x,NA,\n2,,null,7,NA\n3,-0.25,#N/A,8,\n4,1e3,None,,n/a\n"
    path = _write(scratch, text)
    ours = read_csv(spark, path).orderBy("a").toPandas()
    theirs = pd.read_csv(path)
    assert dict(read_csv(spark, path).dtypes)["e"] == "double" and theirs["e"].dtype == "float64"
    for c in theirs.columns:
        got = [None if pd.isna(v) else v for v in ours[c]]
        want = [None if pd.isna(v) else v for v in theirs[c]]
        assert got == want, c


def test_export_bytes_equal_pandas_to_csv(spark, scratch):
    import glob

    import pandas as pd

    rows = [(1, 1.5, "a,b", True), (2, None, 'say "hi"', False), (3, 1e-05, None, None),
            (4, 100000000.0, "", True), (5, 0.1, "plain", False)]
    df = spark.createDataFrame(rows, "i long, x double, s string, b boolean")
    out = scratch("bytes")
    Release(df.coalesce(1), Metadata({})).export_csv(out)
    ours = open(glob.glob(local_path(out) + "/part-*.csv")[0], encoding="utf-8").read()
    assert ours == pd.DataFrame(rows, columns=["i", "x", "s", "b"]).to_csv(index=False)


def _csv(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_short_rows_are_padded_and_long_ones_raise(spark, tmp_path):
    from veil.sources.csv import read_csv

    rows = read_csv(spark, _csv(tmp_path, "a.csv", 'a,b,c\n1,x,2.5\n2\n3,"y,z"\n')).collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (2, None, None), (3, "y,z", None)]
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, _csv(tmp_path, "b.csv", "a,b\n1,2\n1,2,3\n")).collect()


def test_fields_over_several_lines(spark, tmp_path):
    from veil.sources.csv import read_csv

    path = _csv(tmp_path, "m.csv", 'a,b\n1,"x\ny"\n2,z\n\n3,"say ""\n\n"" twice"\n4\n')
    want = [(1, "x\ny"), (2, "z"), (3, 'say "\n\n" twice'), (4, None)]
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == want
    assert sorted(tuple(r) for r in read_csv(spark, path, multiLine=True).collect()) == want
    with pytest.raises(ValueError, match="never ends"):
        read_csv(spark, _csv(tmp_path, "n.csv", 'a,b\n1,"x\n2,y\n'))
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, _csv(tmp_path, "o.csv", 'a,b\n1,"x\ny"\n1,2,3\n')).collect()
    both = tmp_path / "both"
    _csv(both, "p.csv", 'a,b\n1,"x\ny"\n')
    _csv(both, "q.csv", 'b,a\n1,"x\ny"\n')
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(both)).collect()


def test_records_over_lines_are_read_by_several_tasks(spark, tmp_path):
    """Blocks of a file begin anywhere, also within quotes; the rows equal those of pandas."""
    import random

    import pandas as pd

    from veil.sources import records
    from veil.sources.csv import _READ_DEFAULTS, read_csv

    rng = random.Random(2)
    texts = ["".join(rng.choice(['a', 'é', '"', ",", "\n", "\n\n", " "]) for _ in range(rng.randrange(1, 40))) + "." for _ in range(3000)]
    frame = pd.DataFrame({"i": range(3000), "the text": texts, "k": [f"k{i % 7}" for i in range(3000)]})
    path = str(tmp_path / "big.csv")
    frame.to_csv(path, index=False, lineterminator="\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        blocks = records.lines_of(spark, path, _READ_DEFAULTS).select("block").distinct().count()
        got = sorted(tuple(r) for r in read_csv(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 3
    assert got == [tuple(r) for r in pd.read_csv(path).itertuples(index=False)]


def test_files_are_split(spark, tmp_path):
    from veil.sources.csv import read_csv

    path = _csv(tmp_path, "big.csv", "a,b\n" + "".join(f"{i},text {i}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        df = read_csv(spark, path)
        parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 1 and df.count() == 60_000


def test_every_files_header_is_checked(spark, tmp_path):
    from veil.sources.csv import read_csv

    _csv(tmp_path, "d/1.csv", "a,b\n1,2\n")
    _csv(tmp_path, "d/2.csv", "b,a\n3,4\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "d")).collect()


def test_missing_tokens_with_a_schema(spark, tmp_path):
    from pyspark.sql.types import StructType

    from veil.sources.csv import read_csv

    path = _csv(tmp_path, "s.csv", "a,b\nNA,1\n2,null\n")
    rows = read_csv(spark, path, schema=StructType.fromDDL("a long, b string")).collect()
    assert [tuple(r) for r in rows] == [(None, "1"), (2, None)]


def test_export_never_touches_its_input(spark, tmp_path, monkeypatch):
    from veil.sources.csv import read_csv, write_csv

    monkeypatch.chdir(tmp_path)
    spark.range(5).write.mode("overwrite").csv(f"{tmp_path}/in put/rel", header=True)
    df = read_csv(spark, f"{tmp_path}/in put/rel")
    for target in (f"{tmp_path}/in put/rel", f"file://{tmp_path}/in put/rel", "in put/rel", f"{tmp_path}/in put",
                   f"{tmp_path}/in put/rel/sub", f"{tmp_path}/in put/../in put/rel/"):
        with pytest.raises(ValueError, match="Refusing"):
            write_csv(df, target)
    assert df.count() == 5


def test_export_options(spark, tmp_path):
    from veil.sources.csv import read_csv, write_csv

    df = spark.createDataFrame([(1, 2.675, "x"), (2, None, "y"), (3, 0.125, "z")], "a int, b double, c string")
    write_csv(df.coalesce(1), f"{tmp_path}/out", columns=["c", "b"], float_format="%.2f")
    got = sorted(tuple(r) for r in read_csv(spark, f"{tmp_path}/out").collect())
    assert got == [("x", 2.68), ("y", None), ("z", 0.12)]
    with pytest.raises(ValueError, match="Unknown export option"):
        write_csv(df, f"{tmp_path}/out", colums=["a"])
    with pytest.raises(KeyError):
        write_csv(df, f"{tmp_path}/out", columns=["nope"])
