"""Paths whose values may be of several types."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import templates
from sparkloom.functions.paths import compile_path
from sparkloom.functions.values import Mixed, Value
from sparkloom.plans.config import from_dict
from sparkloom.plans.rewrite import rewrite

SCHEMA = "n long, t string, f double, b boolean, gone string, s struct<a:long,z:string>, o struct<x:string>, xs array<long>, ts array<string>, c array<struct<role:string,n:int,w:double>>"
ROWS = [
    (3, "hi", 1.5, True, None, (1, "z"), ("q",), [1, 2], ["a", "b"], [("u", 3, 0.5), ("v", 1, None)]),
    (0, "", 0.5, False, None, (None, "y"), None, [], [], [("w", None, 2.0)]),
]
#: What each path gives for both rows, as JSON.
CASES = {
    "[n, t]": ([3, "hi"], [0, ""]), "[n, t, gone, b]": ([3, "hi", None, True], [0, "", None, False]), "t || n": ("hi", 0), "n && t": ("hi", ""), "gone || [n, t]": ([3, "hi"], [0, ""]),
    "s.*": ([1, "z"], ["y"]), "c[0].*": (["u", 3, 0.5], ["w", 2.0]), "c[*].[role, n]": ([["u", 3], ["v", 1]], [["w", None]]), "c[*].*": ([["u", 3, 0.5], ["v", 1]], [["w", 2.0]]),
    "c[*].[role, n][]": (["u", 3, "v", 1], ["w"]), "values({a: n, b: t})": ([3, "hi"], [0, ""]), "{a: t || n, b: `1`}": ({"a": "hi", "b": 1}, {"a": 0, "b": 1}),
    "[n, [t, f]]": ([3, ["hi", 1.5]], [0, ["", 0.5]]), "[xs, ts]": ([[1, 2], ["a", "b"]], [[], []]), "[xs, ts][]": ([1, 2, "a", "b"], []), "[n, xs, t][]": ([3, 1, 2, "hi"], [0, ""]),
    "[n, t][0]": (3, 0), "[n, t][-1]": ("hi", ""), "[n, t][::-1]": (["hi", 3], ["", 0]), "[s, o][0].a": (1, None), "[s, o][*].x": (["q"], []), "[s, n, t][*].a": ([1], []),
    "(t || n).x": (None, None), "[n, t][?@ == 'hi']": (["hi"], []), "[n, t][?@ == `0`]": ([], [0]), "[n, f, t][?@ > `1`]": ([3, 1.5], []), "[n, t][?type(@) == 'number']": ([3], [0]),
    "map(&type(@), [n, t, gone, b, xs, s])": (["number", "string", "null", "boolean", "array", "object"],) * 2, "map(&to_string(@), [n, t, b, xs])": (["3", "hi", "true", "[1,2]"], ["0", "", "false", "[]"]),
    "to_number(t || n)": (None, 0), "length([n, t])": (2, 2), "contains([n, t], 'hi')": (True, False), "contains([n, t], `3`)": (True, False), "[n, t] == [n, t]": (True, True), "[n, t] == [t, n]": (False, False),
    "(t || n) == 'hi'": (True, False), "(t || n) != `0`": (True, False), "!(t || n)": (False, False), "!([n, t][1])": (False, True), "not_null(gone, n, t)": (3, 0), "to_array(t || n)": (["hi"], [0]),
    "reverse([n, t])": (["hi", 3], ["", 0]), "join('-', [gone || t, t || 'e'])": ("hi-hi", "-e"), "length([t || n, 'abc'][1])": (3, 3), "merge({a: n}, {a: t}).a": ("hi", ""), "`[1, \"x\", [2]]`": ([1, "x", [2]],) * 2,
    "max([n, f])": (3, 0.5), "sum([[n, t][0], n])": (6, 0), "keys([s, o][0])": (["a", "z"],) * 2, "[s, o][0] == s": (True, True), "[n, t] | [0]": (3, 0), "(t || xs)[0]": (None, None), "(gone || xs || t)": ([1, 2], ""),
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def root(df):
    return Value(F.struct(*df.columns), df.schema)


def plain(x):
    """A collected value as JSON has it."""
    if hasattr(x, "toPython"):
        return plain(x.toPython())
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def test_values(df):
    got = df.select(*[compile_path(p, root(df)).col.alias(f"c{i}") for i, p in enumerate(CASES)]).collect()
    got = sorted(got, key=lambda r: plain(r["c0"])[0], reverse=True)
    wrong = {p: (g, w) for i, (p, w) in enumerate(CASES.items()) if (g := tuple(plain(r[i]) for r in got)) != w}
    assert not wrong


def test_types(df):
    for p in CASES:
        v = compile_path(p, root(df))
        assert v.type.simpleString() == df.select(v.col.alias("v")).schema["v"].dataType.simpleString(), p
    assert isinstance(compile_path("t || n", root(df)).type, Mixed)
    assert compile_path("[n, n]", root(df)).type.simpleString() == "array<bigint>"  # types that unify keep their typed plan


@pytest.mark.parametrize("path", ["sum([n, t])", "length(n || t)", "join('-', [n, t])", "max([t, b])", "abs(t || n)"])
def test_wrong_types_fail_where_they_occur(df, path):
    with pytest.raises(PySparkException):
        df.filter("n = 3").select(compile_path(path, root(df)).col).collect()


def test_mixed_values_in_templates(df):
    names = {"v": compile_path("t || n", root(df)), "l": compile_path("[n, t, [f, b]]", root(df)), "o": compile_path("[s, o]", root(df)), "x": compile_path("c[*].*", root(df))}
    cases = {
        "{{ v }} ": ("hi ", "0 "), "{{ l }} ": ("[3, 'hi', [1.5, True]] ", "[0, '', [0.5, False]] "), "{{ 'y' if v else 'n' }}": ("y", "n"), "{% for e in l %}{{ e }};{% endfor %}": ("3;hi;[1.5, True];", "0;;[0.5, False];"),
        "{{ o[0].z }}{{ o[0] }}": ("z{'a': 1, 'z': 'z'}", "y{'a': None, 'z': 'y'}"), "{{ l|tojson }}": ('[3, "hi", [1.5, true]]', '[0, "", [0.5, false]]'), "{{ v == 'hi' }}{{ v == 0 }}": ("TrueFalse", "FalseTrue"),
        "{% for e in x %}{% for y in e %}{{ y }} {% endfor %}{% endfor %}": ("u 3 0.5 v 1 ", "w 2.0 "),
    }
    got = df.select("n", *[templates.render(t, names).col.alias(f"c{i}") for i, t in enumerate(cases)]).orderBy(F.desc("n")).collect()
    wrong = {t: (g, w) for i, (t, w) in enumerate(cases.items()) if (g := tuple(r[f"c{i}"] for r in got)) != w}
    assert not wrong


def test_mixed_variables_of_a_plan(spark, df, tmp_path):
    """Their types go with the variables from step to step, and they are written as VARIANT."""
    config = from_dict({"processing_params": {
        "inputs": [{"name": "v", "key": "[n, t]"}, {"name": "w", "key": "c[0].*"}],
        "outputs": [{"name": "a", "type": "expr", "key": "v[1] || v[0]"}, {"name": "b", "type": "expr", "template": "{{ a }}/{{ w }}"}],
        "output_schema": {"raw": "{{ v }}", "a": "{{ a }}", "text": "{{ b }}: {{ v[0] }}"}, "remove_columns": True,
    }})
    rewrite(df, config).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("text").collect()
    assert [(plain(r["raw"]), plain(r["a"]), r["text"]) for r in got] == [([0, ""], 0, "0/['w', 2.0]: 0"), ([3, "hi"], "hi", "hi/['u', 3, 0.5]: 3")]
    assert json.dumps(plain(got[0]["raw"])) == '[0, ""]'
