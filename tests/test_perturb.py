import pytest
from pyspark.sql import functions as F

from veil import Metadata, Release


def test_zero_noise_identity(staff):
    df, md = staff
    r = Release(df, md).perturb("years", noise_std=0.0, random_state=1)
    assert r.compute_precision_privacy_tradeoff() == (100.0, 0.0)


def test_bounds_types_and_seed(staff):
    df, md = staff
    r = Release(df, md).perturb("years", noise_std=0.3, random_state=7)
    w = r.working()
    mm = w.agg(F.min("years"), F.max("years")).first()
    lo, hi = df.agg(F.min("years"), F.max("years")).first()
    assert lo <= mm[0] and mm[1] <= hi
    assert dict(w.dtypes)["years"] == "bigint"
    a = [x["years"] for x in w.orderBy("badge").collect()]
    b = [x["years"] for x in Release(df.repartition(5), md).perturb("years", 0.3, random_state=7).working().orderBy("badge").collect()]
    assert a == b
    c = [x["years"] for x in Release(df, md).perturb("years", 0.3, random_state=8).working().orderBy("badge").collect()]
    assert a != c


def test_noise_statistics(spark):
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    md = Metadata({"l_extendedprice": "numeric"}, identifiers=["l_orderkey", "l_linenumber"])
    f = Release(li, md).perturb("l_extendedprice", noise_std=0.001, random_state=3).frame
    d = f.select((F.col("l_extendedprice") - F.col("__orig_l_extendedprice")).alias("d"))
    rng = li.agg(F.max("l_extendedprice") - F.min("l_extendedprice")).first()[0]
    s = d.agg(F.avg("d"), F.stddev("d")).first()
    assert abs(s[0]) < 0.05 * rng * 0.001 * 10
    assert 0.9 < s[1] / (rng * 0.001) < 1.1


def test_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None)], "i long, v double, n double")
    r = Release(df, Metadata({"v": "numeric", "n": "numeric"}))
    assert [x["v"] for x in r.perturb("v", 0.5, random_state=1).working().collect()] == [5.0, 5.0]
    assert [x["n"] for x in r.perturb("n", 0.5, random_state=1).working().collect()] == [None, None]


def test_errors(spark):
    df = spark.createDataFrame([(1, 5.0, "a")], "i long, v double, s string")
    r = Release(df, Metadata({"v": "numeric", "s": "numeric"}))
    with pytest.raises(ValueError):
        r.perturb("v", -0.1)
    with pytest.raises(TypeError):
        r.perturb("s", 0.1)
    with pytest.raises(TypeError):
        Release(df, Metadata({})).perturb("v", 0.1)


def test_nulls_stay_null_among_values(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, None), (3, 9.0, 9)], "i long, v double, n long")
    r = Release(df, Metadata({"v": "numeric", "n": "numeric"})).perturb("v", 0.2, random_state=3).perturb("n", 0.2, random_state=3)
    got = r.working().orderBy("i").collect()
    assert got[1]["v"] is None and got[1]["n"] is None and got[0]["v"] is not None


def test_seed_never_appears_in_plans(spark):
    import io
    from contextlib import redirect_stdout

    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "i long, v double")
    w = Release(df, Metadata({"v": "numeric"}, identifiers=["i"])).perturb("v", 0.1, random_state=987654321).working()
    buf = io.StringIO()
    with redirect_stdout(buf):
        w.explain("extended")
    assert "987654321" not in buf.getvalue()


def test_row_keyed_noise_on_wide_text_rows(spark):
    """No identifiers: noise keyed by a fingerprint of the whole original row; still partition-proof."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    md = Metadata({"n_chars": "numeric"})
    a = Release(docs, md).perturb("n_chars", 0.1, random_state=4).working().select("doc_id", "n_chars")
    b = Release(docs.repartition(7), md).perturb("n_chars", 0.1, random_state=4).working().select("doc_id", "n_chars")
    assert sorted(a.collect()) == sorted(b.collect())
    changed = a.join(docs.select("doc_id", F.col("n_chars").alias("o")), "doc_id").where("n_chars != o").count()
    assert changed > 0
