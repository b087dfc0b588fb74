import pytest

from veil import Metadata, Release

from .test_pseudonyms import PEOPLE


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "rid long, name string, code long, score double")


@pytest.mark.parametrize("kwargs", [
    {"column_types": {"nope": "numeric"}},
    {"column_types": {}, "identifiers": ["nope"]},
    {"column_types": {}, "quasi_identifiers": ["nope"]},
    {"column_types": {}, "sensitive_attributes": ["nope"]},
    {"column_types": {"Name": "categorical"}},  # names are case-sensitive
])
def test_unknown_columns(people, kwargs):
    with pytest.raises(ValueError):
        Release(people, Metadata(**kwargs))


def test_bad_declarations():
    with pytest.raises(ValueError):
        Metadata({"a": "text"})
    with pytest.raises(TypeError):
        Metadata({}, identifiers="a")


def test_reserved_prefix_and_duplicates(spark):
    with pytest.raises(ValueError):
        Release(spark.createDataFrame([(1,)], "__orig_x long"), Metadata({}))


def test_json_roundtrip():
    md = Metadata({"a": "numeric"}, identifiers=["a"], quasi_identifiers=["b"], sensitive_attributes=["c"])
    assert Metadata.from_json(md.to_json()) == md
    assert md.numeric_columns == ["a"] and md.weight("c") == 2.0 and md.weight("a") == 1.0


def test_views_and_reset(people):
    md = Metadata({"code": "numeric", "score": "numeric"}, identifiers=["name", "code"])
    r = Release(people, md)
    g = r.generalize("code", 2)
    assert g.changed_columns == ["code"]
    assert "__orig_code" in g.frame.columns and "__orig_code" not in g.working().columns
    assert g.original().collect() == r.original().collect()
    assert g.reset().working().collect() == r.working().collect()
    assert g.get_working_dataset().columns == people.columns


def test_checkpoint_keeps_everything(people):
    md = Metadata({"code": "numeric", "score": "numeric"}, identifiers=["name", "code"], sensitive_attributes=["score"])
    r = Release(people, md).order_preserving_pseudonyms("name").generalize("code", 2)
    c = r.checkpoint()
    assert c.working().exceptAll(r.working()).count() == 0
    assert c.original().exceptAll(r.original()).count() == 0
    assert c.compute_precision_privacy_tradeoff() == r.compute_precision_privacy_tradeoff()
    assert sorted(x["name"] or "" for x in c.reverse_pseudonyms().working().collect()) == ["", "Z", "b", "b", "é"]
    assert "Scan parquet" in c.working()._jdf.queryExecution().executedPlan().toString()


def test_from_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"id": [1, 2, 3], "age": [20.0, float("nan"), 40.0], "name": ["a b", None, "c"]})
    r = Release.from_pandas(spark, pdf, Metadata({"age": "numeric"}, identifiers=["id"]))
    assert [x["age"] for x in r.working().orderBy("id").collect()] == [20.0, None, 40.0]
    assert r.generalize("age", 2).working().where("age is null").count() == 1


def test_workspace_mutates_in_place(people, scratch, spark):
    from veil import Workspace

    md = Metadata({"code": "numeric", "score": "numeric"}, identifiers=["name", "code"], sensitive_attributes=["score"])
    w = Workspace(people, md)
    assert w.deidentify_with_order_preserving_pseudonyms() is None
    assert w.ope_mapping_columns == ["name", "code"]
    w.generalize_numeric_column("score", bins=2)
    with pytest.raises(TypeError):
        w.generalize_numeric_column("name")  # failing call: nothing changes
    assert w.changed_columns == ["name", "code", "score"]
    w.reverse_order_preserving_pseudonyms()
    assert sorted(x["code"] or 0 for x in w.get_working_dataset().collect()) == [0, 10, 20, 30, 30]
    p = scratch("ws")
    w.save(p)
    again = Workspace.load(spark, p)
    assert again.compute_precision_privacy_tradeoff() == w.compute_precision_privacy_tradeoff()
    w.reset_working_dataset()
    assert w.changed_columns == []
