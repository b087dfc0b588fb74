import math

from pyspark.sql import functions as F

import pytest

from veil import Metadata, Release

from .test_pseudonyms import PEOPLE, PEOPLE_META


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "rid long, name string, code long, score double")


def test_untouched_with_nulls(people):
    p, q = Release(people, PEOPLE_META).compute_precision_privacy_tradeoff()
    assert p == pytest.approx(76.0) and q == pytest.approx(24.0)


def test_untouched_staff(staff):
    df, md = staff
    assert Release(df, md).compute_precision_privacy_tradeoff() == (100.0, 0.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert Release(df, Metadata({})).compute_precision_privacy_tradeoff() == (100.0, 0.0)


def test_number_vs_text_never_equal(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "i long, v long")
    r = Release(df, Metadata({}, identifiers=["v"])).mask("v", "mask_first_k", k=0)
    assert r.compute_precision_privacy_tradeoff() == (50.0, 50.0)


def test_people_statistics(people):
    rows = {r["column"]: r for r in Release(people, PEOPLE_META).statistics().collect()}
    s = rows["score"]
    assert (s["count"], s["unique_count"], s["nulls"]) == (3, 2, 2)
    assert s["mean"] == pytest.approx(5.5 / 3) and (s["min"], s["max"], s["median"]) == (1.5, 2.5, 1.5)
    assert s["std"] == pytest.approx(math.sqrt(((1.5 - 5.5 / 3) ** 2 * 2 + (2.5 - 5.5 / 3) ** 2) / 2))
    n = rows["name"]
    assert (n["type"], n["count"], n["unique_count"], n["nulls"], n["mean"]) == ("categorical", 4, 3, 1, None)
    assert [r["column"] for r in Release(people, PEOPLE_META).statistics().collect()] == ["rid", "name", "code", "score"]


def test_staff_statistics(staff):
    df, md = staff
    rows = {r["column"]: r for r in Release(df, md).statistics(use_working=False).collect()}
    age = rows["years"]
    pdf = df.toPandas()
    for got, values in ((age, pdf["years"]), (rows["office"], pdf["office"])):
        assert (got["count"], got["unique_count"], got["nulls"]) == (150, values.nunique(), 0)
        assert got["mean"] == pytest.approx(values.mean()) and got["std"] == pytest.approx(values.std())
        assert got["median"] == values.median()


def test_statistics_after_pseudonyms_and_empty(staff, spark):
    df, md = staff
    rows = {r["column"]: r for r in Release(df, md).random_pseudonyms().statistics().collect()}
    assert rows["badge"]["count"] == 150 and rows["badge"]["mean"] is None
    empty = spark.createDataFrame([], "a long, b string")
    st = Release(empty, Metadata({"a": "numeric"})).statistics().collect()
    assert [(r["column"], r["count"], r["unique_count"], r["nulls"], r["mean"]) for r in st] == [
        ("a", 0, 0, 0, None), ("b", 0, 0, 0, None)]


def test_median_matches_exact_on_larger_table(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    md = Metadata({"o_totalprice": "numeric", "o_custkey": "numeric"})
    rows = {r["column"]: r for r in Release(o, md).statistics().collect()}
    pdf = o.select("o_totalprice", "o_custkey").toPandas()
    assert rows["o_totalprice"]["median"] == pytest.approx(float(pdf["o_totalprice"].median()), abs=1e-9)
    assert rows["o_custkey"]["median"] == pytest.approx(float(pdf["o_custkey"].median()), abs=1e-9)
    assert rows["o_custkey"]["unique_count"] == pdf["o_custkey"].nunique()
    approx = {r["column"]: r for r in Release(o, md).statistics(approx=True).collect()}
    assert approx["o_totalprice"]["count"] == 15000


def test_distributed_selection_median(spark, monkeypatch):
    """Medians from range-partitioned selection equal pandas."""
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_totalprice", "o_custkey")
    md = Metadata({"o_totalprice": "numeric", "o_custkey": "numeric"})
    rows = {r["column"]: r for r in Release(o, md).statistics().collect()}
    pdf = o.toPandas()
    for c in ("o_totalprice", "o_custkey"):
        assert rows[c]["median"] == pytest.approx(float(pdf[c].median()), abs=1e-9)
        assert rows[c]["std"] == pytest.approx(float(pdf[c].std()), rel=1e-12)
    odd = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 9]], "v double")
    r = Release(odd, Metadata({"v": "numeric"})).statistics().first()
    assert r["median"] == 3.0


@pytest.mark.parametrize("table", ["events", "orders", "part"])
def test_statistics_equal_pandas(spark, table):
    """count / nunique / nulls exactly, mean / std / median to 1e-9 relative, against pandas on whole tables."""
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double")]
    md = Metadata({c: "numeric" for c in numeric})
    rows = {r["column"]: r for r in Release(df, md).statistics().collect()}
    pdf = df.toPandas()
    for c in df.columns:
        s = pdf[c]
        r = rows[c]
        assert (r["count"], r["unique_count"], r["nulls"]) == (s.count(), s.nunique(), s.isna().sum())
        if c in numeric:
            x = s.astype("float64")
            for got, want in ((r["mean"], x.mean()), (r["std"], x.std()), (r["median"], x.median()),
                              (r["min"], x.min()), (r["max"], x.max())):
                assert got == pytest.approx(float(want), rel=1e-9, abs=1e-9)
        else:
            assert r["mean"] is None and r["median"] is None


def test_metric_equals_pandas_formula(spark):
    """The reference's formula on pandas objects (dtype-aware ==, NaN != NaN) gives our number."""
    c = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    c = c.withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_acctbal")))
    md = Metadata({"c_custkey": "numeric", "c_acctbal": "numeric", "c_nationkey": "numeric"},
                  identifiers=["c_custkey"], sensitive_attributes=["c_acctbal"])
    r = (Release(c, md).random_pseudonyms(secret="s").mask("c_name", "mask_regex", regex_pattern=r"0+")
         .generalize("c_acctbal", 5).mask("c_nationkey", "mask_first_k", k=0))
    import numpy as np

    pdf = r.frame.toPandas()
    weights = np.array([2.0 if c in md.sensitive_attributes else 1.0 for c in r.columns])
    # equal cells per column under pandas semantics: dtype-aware ==, missing never equal
    before = [pdf.get(f"__orig_{c}", pdf[c]) for c in r.columns]
    before = [b.astype("float64") if c == "c_acctbal" else b for b, c in zip(before, r.columns)]
    # `==`, not .eq(): for object columns pandas' .eq() counts None == None as equal, `==` does not
    equal = np.array([int((b == pdf[c]).fillna(False).sum()) for b, c in zip(before, r.columns)])
    want = float(weights @ equal) / float(weights.sum() * len(pdf)) * 100.0
    assert r.compute_precision_privacy_tradeoff()[0] == pytest.approx(want, rel=1e-12)


def test_statistics_equal_pandas_on_random_tables(spark):
    """Random tables with nulls, -0.0, huge integers and numeric text: pandas' numbers, to 1e-9."""
    import random

    import pandas as pd

    rnd = random.Random(21)
    for _ in range(6):
        n = rnd.randint(0, 50)

        def rv():
            r = rnd.random()
            if r < 0.15:
                return None
            if r < 0.3:
                return rnd.choice([-0.0, 0.0])
            return rnd.choice([rnd.uniform(-1e3, 1e3), float(rnd.randint(-5, 5)), rnd.uniform(-1e12, 1e12)])

        xs = [rv() for _ in range(n)]
        ks = [None if rnd.random() < 0.1 else rnd.randint(-3, 3) * 10 ** rnd.randint(0, 17) for _ in range(n)]
        ts = [None if rnd.random() < 0.1 else rnd.choice(["a", "1.5", " 2 ", "x", "1e3", "-4"]) for _ in range(n)]
        df = spark.createDataFrame(list(zip(xs, ks, ts)), "x double, k long, t string")
        got = {r["column"]: r for r in Release(df, Metadata({"x": "numeric", "k": "numeric", "t": "numeric"}))
               .statistics().collect()}
        pdf = pd.DataFrame({"x": pd.Series(xs, dtype="float64"), "k": pd.Series(ks, dtype="Int64"),
                            "t": pd.Series(ts, dtype="object")})
        for c in ("x", "k", "t"):
            s, g = pdf[c], got[c]
            assert (g["count"], g["unique_count"], g["nulls"]) == (s.count(), s.nunique(), s.isna().sum())
            num = pd.to_numeric(s, errors="coerce").astype("float64")
            for stat, want in (("mean", num.mean()), ("min", num.min()), ("max", num.max()),
                               ("std", num.std()), ("median", num.median())):
                if want != want:  # NaN: missing
                    assert g[stat] is None, (c, stat)
                else:
                    assert g[stat] == pytest.approx(float(want), rel=1e-9, abs=1e-9), (c, stat)


def test_metric_on_random_verb_chains(spark):
    """Random chains of verbs on tables with nulls: the metric equals its pandas definition."""
    import random

    import numpy as np

    rnd = random.Random(4)
    for _ in range(5):
        n = rnd.randint(1, 30)
        a = [None if rnd.random() < 0.2 else rnd.randint(0, 9) for _ in range(n)]
        b = [None if rnd.random() < 0.2 else rnd.choice([0.5, 1.5, 2.0, -0.0, 0.0, 7.25]) for _ in range(n)]
        s = [None if rnd.random() < 0.2 else rnd.choice(["x y", "q", "7", ""]) for _ in range(n)]
        df = spark.createDataFrame(list(zip(range(n), a, b, s)), "id long, a long, b double, s string")
        md = Metadata({"a": "numeric", "b": "numeric"}, identifiers=["id", "a", "s"],
                      sensitive_attributes=rnd.sample(["a", "b", "s"], rnd.randint(0, 2)))
        r = Release(df, md)
        verbs = [lambda r: r.mask("a", "mask_first_k", k=1), lambda r: r.mask("s", "mask_after_last_space"),
                 lambda r: r.generalize("b", 3), lambda r: r.perturb("b", 0.3, random_state=1),
                 lambda r: r.random_pseudonyms("s", secret="k"), lambda r: r.order_preserving_pseudonyms("a"),
                 lambda r: r.reverse_pseudonyms(force=True)]
        for _ in range(rnd.randint(1, 4)):
            try:
                r = rnd.choice(verbs)(r)
            except (ValueError, TypeError):
                pass
        pdf = r.frame.toPandas()
        weights, equal = [], []
        for c in r.columns:
            weights.append(2.0 if c in md.sensitive_attributes else 1.0)
            if f"__orig_{c}" not in pdf:
                equal.append(int(pdf[c].notna().sum()))
                continue
            o, w = pdf[f"__orig_{c}"], pdf[c]
            numeric = [x.dtype.kind in "iufb" for x in (o, w)]
            same_kind = numeric[0] == numeric[1] or (o.dtype == object and w.dtype == object)
            equal.append(int((o == w).fillna(False).sum()) if same_kind else 0)
        want = float(np.dot(weights, equal)) / (sum(weights) * len(pdf)) * 100.0
        assert r.compute_precision_privacy_tradeoff()[0] == pytest.approx(want, rel=1e-12)
