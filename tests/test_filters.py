import pytest

from lexloom.errors import FilterError
from lexloom.functions.filters import apply_filter, merge_filters, validate


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"t{i}", (None if i % 2 else i), f"202{i % 4}-01-0{1 + i % 3}", {"page": i % 3, "name": None if i == 4 else f"n{i % 2}"}) for i in range(8)]
    return spark.createDataFrame(rows, "id int, content string, number int, date string, meta struct<page:int,name:string>")


def ids(df):
    return sorted(r.id for r in df.collect())


def c(field, op, value):
    return {"field": field, "operator": op, "value": value}


CASES = [
    (c("meta.number", "==", 4), [4]), (c("number", "==", None), [1, 3, 5, 7]), (c("number", "!=", 4), [0, 1, 2, 3, 5, 6, 7]), (c("number", "!=", None), [0, 2, 4, 6]),
    (c("number", ">", 2), [4, 6]), (c("number", ">=", 2), [2, 4, 6]), (c("number", "<", 2), [0]), (c("number", "<=", 2), [0, 2]), (c("number", ">", None), []),
    (c("number", "in", [2, None]), [1, 2, 3, 5, 7]), (c("number", "not in", [2]), [0, 1, 3, 4, 5, 6, 7]), (c("meta.page", "in", []), []), (c("meta.page", "not in", []), list(range(8))),
    (c("meta.date", ">=", "2023-01-01"), [3, 7]), (c("meta.name", "==", "n1"), [1, 3, 5, 7]), (c("meta.nothing", "==", None), list(range(8))),
    ({"operator": "AND", "conditions": [c("number", ">", 0), c("meta.page", "==", 0)]}, [6]), ({"operator": "AND", "conditions": []}, list(range(8))), ({"operator": "OR", "conditions": []}, []),
    ({"operator": "NOT", "conditions": [c("number", ">", 0), c("meta.page", "==", 0)]}, [0, 1, 2, 3, 4, 5, 7]),
]


@pytest.mark.parametrize("spec,want", CASES)
def test_filters(docs, spec, want):
    assert ids(apply_filter(docs, spec)) == want


@pytest.mark.parametrize("spec", [{"field": "a", "operator": "=="}, {"operator": "AND"}, {"conditions": []}, c("a", "~", 1), c("a", "in", (1, 2)), c("a", ">", [1]), c("a", ">", "no date"), {"operator": "XOR", "conditions": []}, {"operator": "AND", "conditions": [{}]}])
def test_malformed(spec):
    with pytest.raises(FilterError):
        validate(spec)


def test_json_variant_and_map_meta(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, '{"a": {"b": 3}}'), (2, "{}")], "id int, meta string")
    assert ids(apply_filter(df, c("meta.a.b", ">", 2))) == [1]
    assert ids(apply_filter(df.withColumn("meta", F.parse_json("meta")), c("meta.a.b", "==", None))) == [2]


def test_pushed_to_the_scan(spark):
    df = apply_filter(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), {"operator": "AND", "conditions": [c("n_chars", ">", 5), c("lang", "==", "en")]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,5)" in plan and "EqualNullSafe(lang,en)" in plan or "EqualTo(lang,en)" in plan


def test_dates_are_pushed_to_the_scan(spark):
    spec = {"operator": "AND", "conditions": [c("o_orderdate", ">=", "1995-03-01"), c("o_orderdate", "<", "1995-06-01T00:00:00")]}
    df = apply_filter(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), spec)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    rows = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP'2024-01-02 10:00:00' AS t, '2024-01-02' AS s, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS n")
    for field in "dtsn":
        assert apply_filter(rows, c(field, ">", "2024-01-01T23:00:00")).count() == 1 and apply_filter(rows, c(field, ">", "2024-01-03")).count() == 0
    assert apply_filter(rows, c("n", "<", "2024-01-02T11:00:00+01:00")).count() == 0 == apply_filter(rows, c("t", "<", "2024-01-02T10:00:00+00:00")).count()


def test_merge():
    a, b = c("x", "==", 1), c("y", "==", 2)
    assert merge_filters("replace", a, b) == b and merge_filters("replace", a, None) == a
    assert merge_filters("merge", a, b) == {"operator": "AND", "conditions": [a, b]}
    assert merge_filters("merge", a, c("x", "==", 5)) == c("x", "==", 5)
    both = {"operator": "AND", "conditions": [a]}
    assert merge_filters("merge", both, b)["conditions"] == [a, b]
    assert merge_filters("merge", both, {"operator": "AND", "conditions": [b]})["conditions"] == [a, b]
    other = {"operator": "OR", "conditions": [b]}
    assert merge_filters("merge", both, other) == other
