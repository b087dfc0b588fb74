import pytest

from veil import Metadata, Release

NAMES = ["Ana María López", "x", "", " lead", "trail ", "a\tb", "😀é 12", "٣4", None]

EXPECTED = {
    ("mask_first_k", 2): ["**a María López", "*", "", "**ead", "**ail ", "**b", "** 12", "**", None],
    ("mask_last_k", 2): ["Ana María Lóp**", "*", "", " le**", "trai**", "a**", "😀é **", "**", None],
    ("mask_before_first_space", None): ["*** María López", "x", "", " lead", "***** ", "a\tb", "** 12", "٣4", None],
    ("mask_after_last_space", None): ["Ana María *****", "x", "", " ****", "trail ", "a\tb", "😀é **", "٣4", None],
}


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(NAMES)], "id long, s string")


def _run(names, strategy, k=None, regex_pattern=None):
    r = Release(names, Metadata({}))
    rows = r.mask("s", strategy, k=k, regex_pattern=regex_pattern).working().orderBy("id").collect()
    return [row["s"] for row in rows]


@pytest.mark.parametrize("strategy,k", list(EXPECTED))
def test_strategies(names, strategy, k):
    assert _run(names, strategy, k=k) == EXPECTED[(strategy, k)]


def test_regex_one_star_per_match_and_unicode_digits(names):
    assert _run(names, "mask_regex", regex_pattern=r"\d")[6:8] == ["😀é **", "**"]
    assert _run(names, "mask_regex", regex_pattern=r"\d+")[6:8] == ["😀é *", "*"]


def test_regex_python_named_groups(names):
    import re

    pattern = r"(?P<w>a)(?P=w)?|\s\Z"
    out = _run(names, "mask_regex", regex_pattern=pattern)
    assert out[:-1] == [re.sub(pattern, "*", s) for s in NAMES[:-1]]


def test_huge_k_masks_everything(names):
    stars = [None if v is None else "*" * len(v) for v in NAMES]
    assert _run(names, "mask_first_k", k=10**12) == stars
    assert _run(names, "mask_last_k", k=10**12) == stars


def test_k_zero_is_identity(names):
    assert _run(names, "mask_first_k", k=0) == NAMES
    assert _run(names, "mask_last_k", k=0) == NAMES


@pytest.mark.parametrize("kwargs", [
    {"strategy": "mask_first_k", "k": -1},
    {"strategy": "mask_last_k", "k": None},
    {"strategy": "nope"},
    {"strategy": "mask_regex", "regex_pattern": ""},
    {"strategy": "mask_regex", "regex_pattern": None},
    {"strategy": "mask_regex", "regex_pattern": "("},
])
def test_errors(names, kwargs):
    with pytest.raises(ValueError):
        Release(names, Metadata({})).mask("s", **kwargs)


def test_missing_column(names):
    with pytest.raises(KeyError):
        Release(names, Metadata({})).mask("nope", "mask_first_k", k=1)


def test_numeric_column_is_stringified_like_python(spark):
    df = spark.createDataFrame(
        [(1, 1e16, True), (2, 1e-5, False), (3, 1e8, None), (4, 0.1, True), (5, 2.5e-4, True), (6, -0.0, True),
         (7, 123456.789, True)],
        "id long, x double, b boolean")
    r = Release(df, Metadata({}))
    got = [row["x"] for row in r.mask("x", "mask_first_k", k=0).working().orderBy("id").collect()]
    assert got == [str(v) for v in (1e16, 1e-5, 1e8, 0.1, 2.5e-4, -0.0, 123456.789)]
    got = [row["b"] for row in r.mask("b", "mask_first_k", k=0).working().orderBy("id").collect()]
    assert got == ["True", "False", None, "True", "True", "True", "True"]
    assert dict(r.mask("x", "mask_last_k", k=1).working().dtypes)["x"] == "string"


def test_staff_mask_last_3(staff):
    df, md = staff
    r = Release(df, md).mask("team", "mask_last_k", k=3)
    vals = sorted(x["team"] for x in r.working().select("team").distinct().collect())
    assert vals == sorted(f"{t[:-3]}***" for t in ("Harbour", "Kitchen", "Workshop", "Archive", "Garden"))
    p, q = r.compute_precision_privacy_tradeoff()
    assert p == pytest.approx(60.0) and q == pytest.approx(40.0)


def test_staff_mask_regex_zipcode(staff):
    df, md = staff
    r = Release(df, md).mask("office", "mask_regex", regex_pattern=r"\d")
    assert {x["office"] for x in r.working().select("office").distinct().collect()} == {"*****"}
    assert r.compute_precision_privacy_tradeoff()[0] == pytest.approx(80.0)


def test_no_python_udf_in_mask_plan(spark):
    from veil.plans.inspect import python_nodes

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = Release(df, Metadata({})).mask("text", "mask_regex", regex_pattern=r"\d+").mask("lang", "mask_first_k", k=1)
    assert python_nodes(r.working()) == []


def _py_mask(text, strategy, k=None, pattern=None):
    """Brute-force definition, character by character: which positions become a star."""
    import re

    if text is None:
        return None
    if strategy == "mask_regex":
        return re.sub(pattern, "*", text)
    n = len(text)
    spaces = [i for i, ch in enumerate(text) if ch == " "]
    hidden = {
        "mask_first_k": lambda i: i < k,
        "mask_last_k": lambda i: i >= n - k,
        "mask_before_first_space": lambda i: bool(spaces) and i < spaces[0],
        "mask_after_last_space": lambda i: bool(spaces) and i > spaces[-1],
    }[strategy]
    return "".join("*" if hidden(i) else ch for i, ch in enumerate(text))


@pytest.mark.parametrize("strategy,k,pattern", [
    ("mask_first_k", 9, None), ("mask_last_k", 9, None), ("mask_before_first_space", None, None),
    ("mask_after_last_space", None, None), ("mask_regex", None, r"\d+"), ("mask_regex", None, r"\w+@\w+"),
    ("mask_regex", None, r"(?i)\bthe\b"), ("mask_regex", None, r"\s+"),
])
def test_documents_equal_python(spark, strategy, k, pattern):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in
           Release(docs, Metadata({})).mask("text", strategy, k=k, regex_pattern=pattern).working().collect()}
    src = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = [d for d, t in src.items() if got[d] != _py_mask(t, strategy, k, pattern)]
    assert bad == []


def test_sql_functions_match_masks(spark, names):
    from veil.functions.sql import register_sql_functions

    register_sql_functions(spark)
    names.createOrReplaceTempView("veil_names")
    rows = spark.sql("SELECT id, veil_mask_first_k(s, 2) AS a, veil_mask_last_k(s, 2) AS b, "
                     "veil_mask_before_first_space(s) AS c, veil_mask_after_last_space(s) AS d, "
                     "veil_mask_first_k(s, 2000000000) AS e, veil_mask_last_k(s, 2000000000) AS f "
                     "FROM veil_names ORDER BY id").collect()
    assert [r["a"] for r in rows] == EXPECTED[("mask_first_k", 2)]
    assert [r["b"] for r in rows] == EXPECTED[("mask_last_k", 2)]
    assert [r["c"] for r in rows] == EXPECTED[("mask_before_first_space", None)]
    assert [r["d"] for r in rows] == EXPECTED[("mask_after_last_space", None)]
    stars = [None if v is None else "*" * len(v) for v in NAMES]
    assert [r["e"] for r in rows] == stars and [r["f"] for r in rows] == stars


def test_python_regex_classes_and_line_ends(spark):
    """\\w excludes combining marks, \\s includes \\x1c-\\x1f, '.' and '$' treat only \\n as a line end."""
    import re

    texts = ["x́yb ", "a\x1cb c", "r\rs\nt", "²_‿", "end\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for pattern in (r"\w+", r"\W", r"\s", r"\S+", r"\b", r"\B", r".", r"$", r"^.", r"(?a)\w+"):
        got = [r["s"] for r in Release(df, Metadata({})).mask("s", "mask_regex", regex_pattern=pattern)
               .working().orderBy("i").collect()]
        assert got == [re.sub(pattern, "*", t) for t in texts], pattern


def test_three_digit_exponents(spark):
    vals = [-5.694946403451123e-209, 1.3481316636868863e+217, 2.5e-310, 1e100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r["v"] for r in Release(df, Metadata({})).mask("v", "mask_first_k", k=0).working().orderBy("i").collect()]
    assert got == [str(v) for v in vals]


def test_more_python_escapes(spark):
    import re

    texts = ["a\x0bb\nc", "x😀y", "p #q r", "tab\tend"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for pattern in (r"\v", r"[\v]", r"\U0001F600", r"(?x) [ #] q", r"(?x)[ ]", r"\t"):
        got = [r["s"] for r in Release(df, Metadata({})).mask("s", "mask_regex", regex_pattern=pattern)
               .working().orderBy("i").collect()]
        assert got == [re.sub(pattern, "*", t) for t in texts], pattern


def test_case_insensitive_unicode(spark):
    import re

    texts = ["KKk", "sſS", "İiıI", "ß ss SS", "σςΣ", "Éée", "ǅǄǆ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for pattern in (r"(?i)k", r"(?i)s", r"(?i)i", r"(?i)σ", r"(?i)é", r"(?i)ǅ", r"(?i)[a-z]+"):
        got = [r["s"] for r in Release(df, Metadata({})).mask("s", "mask_regex", regex_pattern=pattern)
               .working().orderBy("i").collect()]
        assert got == [re.sub(pattern, "*", t) for t in texts], pattern
