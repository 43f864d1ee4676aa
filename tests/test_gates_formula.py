"""All rules in one scan against a count by hand; formula text against its design columns."""

import pytest

from spanloom.operators import expect as X
from spanloom.operators.formula import formula_columns, parse_formula

DATA = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, None), (None, 1, 3.0), (None, 1, 9.0), ("b", None, 4.0), ("b", 3, 4.0)]
SCHEMA = "k string, i int, v double"


def by_hand(rows, cols):
    keys = [tuple(r[c] for c in cols) for r in rows]
    return sum(keys.count(k) > 1 for k in keys)


def rules(df):
    return [
        *X.not_null("k", "v"),
        X.unique("k", "i"),
        X.within("v", 0, 5),
        X.unique("v"),
        X.unique("i", "k"),  # the same keys in another order
        X.single_value("k"),
        X.unique("k", "i", "v"),
        X.row_count(7),
        X.has_type(df, "i", "string"),
    ]


@pytest.mark.parametrize("repeat", [0, 1, 2])
def test_mixed_rules_equal_a_count_by_hand(spark, repeat):
    data = DATA * repeat
    df = spark.createDataFrame(data, SCHEMA)
    n = len(data)
    expected = [n * 2 // 7, n // 7, by_hand(data, (0, 1)), n // 7, by_hand(data, (2,)), by_hand(data, (0, 1)), int(n > 0), by_hand(data, (0, 1, 2)), abs(n - 7), 1]
    got = X.report(df, rules(df)).collect()
    assert [(r.n_rows, r.n_failed, r.passed) for r in got] == [(n, e, e == 0) for e in expected]
    assert [r.column for r in got] == [r.column for r in rules(df)]


def test_one_scan_and_one_shuffle_of_the_keys(spark, tmp_path):
    spark.createDataFrame(DATA, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = X.report(df, rules(df))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1


def test_uniqueness_alone_on_an_empty_table(spark):
    got = X.report(spark.createDataFrame([], SCHEMA), [X.unique("k"), X.unique("i", "v")]).collect()
    assert [(r.n_rows, r.n_failed, r.passed) for r in got] == [(0, 0, True)] * 2


@pytest.mark.parametrize(
    "text, terms",
    [
        ("y ~ 1", []),
        ("y~a", [("a",)]),
        ("y ~ a + b + a", [("a",), ("b",)]),
        ("y ~ a * b", [("a",), ("b",), ("a", "b")]),
        ("y ~ a:b + b + b:a", [("b",), ("a", "b")]),
        ("y ~ a*b*c", [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]),
    ],
)
def test_terms_of_a_formula(text, terms):
    assert parse_formula(text) == ("y", terms)


@pytest.mark.parametrize("text", ["y", "y ~", "y ~ a + ", "y ~ log(a)", "y ~ a * -1"])
def test_unreadable_formulas_are_refused(text):
    with pytest.raises(ValueError):
        parse_formula(text)


@pytest.mark.parametrize(
    "text, names",
    [
        ("y ~ 1", ["(Intercept)"]),
        ("y ~ a * b", ["(Intercept)", "a2", "bq", "br", "a2:bq", "a2:br"]),
        ("y ~ a + a:b", ["(Intercept)", "a2", "a1:bq", "a1:br", "a2:bq", "a2:br"]),
        ("y ~ a:b", ["(Intercept)", "a1:bp", "a1:bq", "a1:br", "a2:bp", "a2:bq", "a2:br"]),
    ],
)
def test_columns_of_a_formula(spark, text, names):
    columns = formula_columns(text, {"a": ["1", "2"], "b": ["p", "q", "r"]})
    assert list(columns) == names
    df = spark.createDataFrame([("2", "r"), ("1", "p"), (None, "q")], "a string, b string")
    got = [list(r) for r in df.select(*[v.alias(f"c{i}") for i, v in enumerate(columns.values())]).collect()]
    for (a, b), line in zip([("2", "r"), ("1", "p"), (None, "q")], got):
        held = {f"a{a}", f"b{b}"}
        assert line == [float(n == "(Intercept)" or set(n.split(":")) <= held) for n in names]
