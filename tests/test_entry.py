from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E._own_oracles()) == set(E._own_queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["release_pipeline", "generalize_many_bins", "ope_nulls", "stats_working",
                                  "perturb_seeded", "mask_regex", "precision_pipeline"])
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "part", "lineitem", "conversations", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SMALL)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(sdf.columns)
    key = sorted(cols)
    a = Counter(tuple(r[c] for c in key) for r in sdf.collect())
    b = Counter(tuple(dict(zip(cols, r))[c] for c in key) for r in res.fetchall())
    assert a == b


def test_quickstart_example_runs(spark, capsys):
    import importlib.util
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("quickstart", os.path.join(root, "examples", "quickstart.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    mod.main(os.path.join(root, "tests", "data", "staff.csv"))
    out = capsys.readouterr().out
    assert "precision_pct" in out and "Works***" in out
