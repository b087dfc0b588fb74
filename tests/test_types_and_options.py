from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veil import Metadata, Release, read_csv
from veil.operators.metrics import precision_privacy_between


def test_decimal_and_float_columns_keep_their_type(spark):
    df = spark.createDataFrame([(1, Decimal("1.50"), 1.5), (2, Decimal("9.25"), 9.25), (3, None, None)],
                               "i long, d decimal(10,2), f float")
    md = Metadata({"d": "numeric", "f": "numeric"})
    r = Release(df, md).generalize("d", 2).perturb("f", 0.1, random_state=1)
    assert dict(r.working().dtypes) == {"i": "bigint", "d": "decimal(10,2)", "f": "float"}
    got = r.working().orderBy("i").collect()
    assert got[2]["d"] is None and got[2]["f"] is None


def test_timestamps_mask_like_python_str(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderdate").limit(3)
    r = Release(o, Metadata({})).mask("o_orderdate", "mask_after_last_space")
    assert all(v["o_orderdate"].endswith(" ********") for v in r.working().collect())


def test_snapshot_and_nested_types(spark, scratch):
    df = spark.createDataFrame([(1, [1, 2])], "i long, a array<int>")
    r = Release(df, Metadata({}, identifiers=["a"]), snapshot=True)
    with pytest.raises(TypeError):
        r.random_pseudonyms()
    assert r.original().count() == 1


def test_display_rounding(staff):
    df, md = staff
    r = Release(df, md).generalize("years", 10)
    row = r.precision_privacy(digits=1).first()
    exact = r.precision_privacy().first()
    assert (row["precision_pct"], row["privacy_pct"]) == (round(exact[0], 1), round(exact[1], 1))
    st = {x["column"]: x for x in r.statistics(digits=4).collect()}
    assert st["office"]["std"] == round(st["office"]["std"], 4)


def test_precision_between_two_tables(spark, scratch, staff):
    df, md = staff
    r = Release(df, md).generalize("years", 10)
    out = scratch("between")
    r.export_csv(out)
    back = read_csv(spark, out, md)
    row = precision_privacy_between(df, back, ["badge"], md).first()
    assert row["precision_pct"] == pytest.approx(r.compute_precision_privacy_tradeoff()[0])
    with pytest.raises(ValueError):
        precision_privacy_between(df, back.where(F.col("badge") > 5), ["badge"], md)


def test_empty_table_through_every_verb(spark, scratch):
    df = spark.createDataFrame([], "id long, x double, s string")
    md = Metadata({"x": "numeric"}, identifiers=["id"])
    r = Release(df, md).order_preserving_pseudonyms().random_pseudonyms().mask("s", "mask_first_k", k=1)
    assert r.working().count() == 0
    assert r.reverse_pseudonyms(force=True).working().count() == 0
    assert r.compute_precision_privacy_tradeoff() == (100.0, 0.0)
    assert [x["count"] for x in r.statistics().collect()] == [0, 0, 0]
    p = scratch("empty")
    r.save(p)
    assert Release.load(spark, p).working().count() == 0


def test_awkward_column_names(spark, scratch):
    df = spark.createDataFrame([(1, 2.5, "a b"), (2, 7.5, "c d")], "`a.b` long, `we``ird` double, `x y` string")
    md = Metadata({"we`ird": "numeric"}, identifiers=["a.b"], sensitive_attributes=["x y"])
    r = (Release(df, md).order_preserving_pseudonyms().generalize("we`ird", 2)
         .perturb("we`ird", 0.1, random_state=1).mask("x y", "mask_after_last_space"))
    assert r.working().columns == ["a.b", "we`ird", "x y"]
    assert sorted(x["x y"] for x in r.working().collect()) == ["a *", "c *"]
    assert len(r.statistics().collect()) == 3
    p = scratch("awkward")
    r.save(p)
    back = Release.load(spark, p).reverse_pseudonyms()
    assert sorted(x["a.b"] for x in back.working().collect()) == [1, 2]
    out = scratch("awkward-csv")
    back.export_csv(out)
    assert read_csv(spark, out).columns == ["a.b", "we`ird", "x y"]


def test_case_clash_and_non_unique_key(spark):
    clash = spark.createDataFrame([(1, 2)], "a long, A long")
    with pytest.raises(ValueError):
        Release(clash, Metadata({}))
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception):
        precision_privacy_between(a, a, ["k"], Metadata({})).collect()
