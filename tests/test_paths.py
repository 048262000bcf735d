import pytest
from pyspark.sql import functions as F

from sparkloom.functions.paths import PathError, compile_path, parse
from sparkloom.functions.values import PlanError, Value

ROW = (
    1, "hello", [("u", "a", 3), ("v", "b", 1), ("u", None, 2)], [[1, 2], [3]], 2.5, True, {"k": "w"}, [], None,
)
SCHEMA = "id int, text string, c array<struct<role:string,content:string,n:int>>, nn array<array<int>>, x double, flag boolean, m map<string,string>, empty array<int>, gone string"

CASES = {
    "text": "hello", '"text"': "hello", "c[0].content": "a", "c[-1].role": "u", "c[9].role": None, "c[-9]": None, "m.k": "w", "m.none": None,
    "c[*].content": ["a", "b"], "c[].role": ["u", "v", "u"], "nn[]": [1, 2, 3], "c[?role=='u'].n": [3, 2], "c[?n>`1` && role=='u'].n": [3, 2],
    "c[?!content].n": [2], "c[1:].n": [1, 2], "c[:-1].n": [3, 1], "c[::-1].n": [2, 1, 3], "c[::2].n": [3, 2], "c[5:].n": [], "c[2:0:-1].n": [2, 1],
    "empty[0]": None, "empty[*]": [], "gone || text": "hello", "text || 'z'": "hello", "empty || nn[0]": [1, 2], "flag && text == 'hello'": True,
    "!text": False, "!gone": True, "!empty": True, "!id": False, "id == `1`": True, "id != `2`": True, "x >= `2.5`": True, "text < 'z'": True, "text < `1`": None,
    "nn[0] == `[1, 2]`": True, "gone == `null`": True, "text == `1`": False, "{a: text, b: c[0].n}.b": 3, "[text, c[0].role]": ["hello", "u"],
    "c[*].role | [0]": "u", "@.text": "hello", "c[*].[role, content] | [0]": ["u", "a"], "gone.[a]": None,
    "abs(`-2`)": 2, "ceil(x)": 3, "floor(x)": 2, "avg(c[*].n)": 2.0, "avg(empty)": None, "sum(c[*].n)": 6, "sum(empty)": 0, "max(c[*].n)": 3, "min(empty)": None,
    "max_by(c, &n).role": "u", "min_by(c, &n).role": "v", "sort(c[*].n)": [1, 2, 3], "sort_by(c, &n)[*].n": [1, 2, 3], "sort_by(c, &role)[*].n": [3, 2, 1],
    "contains(text, 'ell')": True, "contains(c[*].n, `3`)": True, "contains(c[*].n, 'a')": False, "starts_with(text, 'he')": True, "ends_with(text, 'he')": False,
    "join('-', c[*].role)": "u-v-u", "join('-', c[?n>`9`].role)": "", "length(text)": 5, "length(c)": 3, "reverse(text)": "olleh", "reverse(c[*].n)": [2, 1, 3],
    "keys(c[0])": ["role", "content", "n"], "keys(m)": ["k"], "values(m)": ["w"], "map(&content, c)": ["a", "b", None], "merge({a: text}, {a: 'z'}).a": "z",
    "merge(m, m).k": "w", "not_null(gone, text)": "hello", "to_array(text)": ["hello"], "to_array(nn[0])": [1, 2], "to_number('1.5')": 1.5, "to_number('z')": None,
    "to_string(nn)": "[[1,2],[3]]", "to_string(text)": "hello", "type(gone)": "null", "type(c)": "array", "type(id)": "number", "type(c[0])": "object", "type(flag)": "boolean",
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW], SCHEMA)


def test_values(df):
    root = Value(F.struct(*df.columns), df.schema)
    columns = [compile_path(p, root).col.alias(f"c{i}") for i, p in enumerate(CASES)]
    got = df.select(*columns).first()
    wrong = {p: (g, w) for (p, w), g in zip(CASES.items(), got, strict=True) if g != w}
    assert not wrong


def test_types(df):
    root = Value(F.struct(*df.columns), df.schema)
    for p in CASES:
        v = compile_path(p, root)
        planned, there = v.type.simpleString(), df.select(v.col.alias("v")).schema["v"].dataType.simpleString()
        assert planned == there, p


@pytest.mark.parametrize("path", ["", "a.", "a[", "a[0", "a ||", "a[::0]", "{}", "a b", "'x", "f(", "a[1:2:3:4]", "#"])
def test_syntax_errors(path):
    with pytest.raises(PathError):
        parse(path)


@pytest.mark.parametrize("path", ["nope", "nope(@)", "length(id)", "sum(text)", "abs(`1`, `2`)", "join('-', nn)", "sum([text, `true`])"])
def test_plan_errors(df, path):
    with pytest.raises(PlanError):
        compile_path(path, Value(F.struct(*df.columns), df.schema))


def test_case_matters(spark):
    df = spark.createDataFrame([("x", "y")], "A string, a string")
    root = Value(F.struct("A", "a"), df.schema)
    assert df.select(compile_path("A", root).col, compile_path("a", root).col).first()[:] == ("x", "y")


def test_only_read_columns_are_scanned(spark, tmp_path):
    spark.createDataFrame([ROW], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.select(compile_path("c[*].role", Value(F.struct(*df.columns), df.schema)).col)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c:array<struct<role:string>>>" in plan or "ReadSchema: struct<c:" in plan
    assert "text" not in plan.split("ReadSchema")[1]
