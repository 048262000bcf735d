import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import pytext, templates
from sparkloom.functions.templates import TemplateError, UnsupportedTemplate, compile_template, free_variables, render, single_variable
from sparkloom.functions.values import PlanError, Value

ROW = (7, "hello", [("u", "a", 3), ("v", "b", 1), ("u", None, 2)], [[1, 2], [3]], 2.5, True, None, datetime.datetime(2024, 1, 2, 3, 4, 5, 500000), ["b", "A", "b"])
SCHEMA = "id int, text string, c array<struct<role:string,content:string,n:int>>, nn array<array<int>>, x double, flag boolean, gone string, at timestamp, names array<string>"
CASES = {
    "Hi {{ text }}!": "Hi hello!", "plain": "plain", "": "", "a\n": "a", "{{ id }}{{ flag }}{{ gone }}|{{ nope }}|{{ none }}": "7TrueNone||None",
    "{{ x }} {{ 10000000000.0 }} {{ 0.00001 }}": "2.5 10000000000.0 1e-05", "{{ nn }} {{ c[0] }} ": "[[1, 2], [3]] {'role': 'u', 'content': 'a', 'n': 3} ",
    "{{ at }} ": "2024-01-02 03:04:05.500000 ", "{{ c[0].role }}{{ c[0]['n'] }}{{ c[-1].content }}": "u3None", "{{ text[0] }}{{ text[-1] }}{{ text[1:3] }}": "hoel",
    "a {#- note -#} b": "ab", "{% raw %}{{ x }}{% endraw %}": "{{ x }}", "x {{- text -}} y": "xhelloy", "{{ 1 + 2 * 3 }} {{ 7 // 2 }} {{ -7 // 2 }} {{ -7 % 3 }} {{ 1 / 4 }} {{ 2 ** 3 }}": "7 3 -4 2 0.25 8",
    "{{ text ~ '-' ~ id }}": "hello-7", "{{ 'a' if flag else 'b' }}{{ 'a' if gone }}": "a", "{{ id > 5 and not gone }}": "True", "{{ 'el' in text }} {{ 3 in nn[0] }} {{ 'z' not in text }}": "True False True",
    "{% if id > 9 %}a{% elif id > 5 %}b{% else %}c{% endif %}": "b", "{% if gone %}a{% endif %}": "", "{% for m in c %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}": "1u,2v,3u",
    "{% for m in c if m.n > 9 %}x{% else %}none{% endfor %}": "none", "{% for r in nn %}[{% for i in r %}{{ i }}{% endfor %}]{% endfor %}": "[12][3]", "{% for i in range(3) %}{{ i }}{% endfor %}": "012",
    "{% set k = id + 1 %}{{ k }}": "8", "{% set b %}<{{ id }}>{% endset %}{{ b }}{{ b }}": "<7><7>", "{% with a = 1, b = text %}{{ a }}{{ b }}{% endwith %}": "1hello",
    "{{ text|upper }} {{ text|capitalize }} {{ 'a-b c'|title }} {{ '  x '|trim }}|": "HELLO Hello A-B C x|", "{{ nope|default('d') }} {{ gone|default('d') }} {{ gone|default('d', true) }}": "d None d",
    "{{ names|join(',') }} {{ names|sort|join }} {{ names|unique|join }} {{ names|min }} {{ names|max }}": "b,A,b Abb bA A b", "{{ c|map(attribute='n')|sum }} {{ c|map(attribute='role')|join('/') }}": "6 u/v/u",
    "{{ c|selectattr('role', 'eq', 'u')|list|length }} {{ c|rejectattr('content')|map(attribute='n')|join }}": "2 2", "{{ '3.7'|int }} {{ 'z'|int(9) }} {{ 3|float }} {{ 2.5|round }} {{ -3|abs }}": "3 9 3.0 2.0 3",
    "{{ c|length }} {{ text|count }} {{ 'a b'|wordcount }} {{ text|reverse }} {{ names|first }}{{ names|last }}": "3 5 2 olleh bb", "{{ '<a&\"'|e }} {{ {'a': '<'}|tojson }}": '&lt;a&amp;&#34; {"a": "\\u003c"}',
    "{{ 'one two three'|truncate(9, false, '...', 0) }}": "one...", "{{ '%s-%d'|format('a', 3) }}": "a-3", "{{ text is defined }}{{ nope is undefined }}{{ gone is none }}{{ id is odd }}{{ 9 is divisibleby 3 }}": "TrueTrueTrueTrueTrue",
    "{{ text is string }}{{ id is number }}{{ c is sequence }}{{ 'A' is upper }}{{ id is eq 7 }}{{ id is not none }}": "TrueTrueTrueTrueTrueTrue", "{{ '<b>x</b>  y'|striptags }} {{ 'a b/c'|urlencode }}": "x y a%20b/c",
    "{{ [1, 'a'][0] if false else 2 }}": None, "{{ text|replace('l', 'L') }}{{ \"q\" 'r' }}": "heLLoqr", "{{ 3 if 1 < id <= 7 else 4 }}": "3",
}
CASES = {k: v for k, v in CASES.items() if v is not None}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW], SCHEMA)


@pytest.fixture(scope="module")
def names(df):
    return {f.name: Value(F.col(f.name), f.dataType) for f in df.schema.fields}


def test_texts(df, names):
    got = df.select(*[render(t, names).col.alias(f"c{i}") for i, t in enumerate(CASES)]).first()
    wrong = {t: (g, w) for (t, w), g in zip(CASES.items(), got, strict=True) if g != w}
    assert not wrong


def test_unpacking_nested_values_macros_and_more_filters(spark):
    floats = [1e22, 0.1, -3.0, 1e16, 123456789.125, 1e-5, 0.0001, 12345678901234567.0, -1.5e-7, 1e100, 2.5e-300]
    df = spark.createDataFrame([(*ROW, {"b": 1.5, "A": 2e-7}, floats)], SCHEMA + ", m map<string,double>, fl array<double>")
    names = {f.name: Value(F.col(f.name), f.dataType) for f in df.schema.fields}
    cases = {
        "{% for k, v in c[0].items() %}{{ k }}={{ v }};{% endfor %}": "role=u;content=a;n=3;",
        "{% for k in c[0] %}{{ k }} {% endfor %}": "role content n ",
        "{% for k, v in m|dictsort %}{{ k }}={{ v }};{% endfor %}": "A=2e-07;b=1.5;",
        "{% for k, v in c[0]|dictsort %}{{ loop.index }}{{ k }}={{ v }}{{ ',' if not loop.last }}{% endfor %}": "1content=a,2n=3,3role=u",
        "{% for k, v in c[0].items() if v is not none %}{{ loop.index }}/{{ loop.length }}{{ k }} {% endfor %}": "1/3role 2/3content 3/3n ",
        "{% for k, v in c[2].items() if v is not none %}{{ loop.index }}/{{ loop.length }}{{ k }} {% else %}none{% endfor %}": "1/2role 2/2n ",
        "{% for x in fl %}{{ x }} {% endfor %}": " ".join(map(repr, floats)) + " ",
        "{% for m in c %}{{ m }}{% endfor %}": str({'role':'u','content':'a','n':3})+str({'role':'v','content':'b','n':1})+str({'role':'u','content':None,'n':2}),
        "{% for r in nn %}{{ r }}{% endfor %}": "[1, 2][3]",
        "{% for x in [id, text, none, 2.5] %}{{ x }},{% endfor %}": "7,hello,None,2.5,",
        "{{ [id, text, \"it's\", 'a\\n'] }} ": str([7,"hello","it's","a\n"])+" ",
        "{% macro hi(n, m='you') %}{{ n }}-{{ m }}{% endmacro %}{{ hi(text) }} {{ hi('a', m=id) }}": "hello-you a-7",
        "{% macro box(t) %}[{{ t }}:{{ caller() }}]{% endmacro %}{% call box('x') %}in {{ id }}{% endcall %}": "[x:in 7]",
        "{% macro each(xs) %}{% for x in xs %}{{ caller(x) }}{% endfor %}{% endmacro %}{% call(y) each(names) %}<{{ y }}>{% endcall %}": "<b><A><b>",
        "{% filter upper|replace('L', '1') %}he{{ text }}{% endfilter %}": "HEHE11O",
        "{% for m in c %}{{ loop.cycle('x', 'y') }}{{ loop.depth }}{% endfor %}": "x1y1x1",
        "{% for i in range(1, 8, 3) %}{{ i }}{% endfor %}{% for i in range(5, 0, -2) %}{{ i }}{% endfor %}{{ range(3, 3, 2)|list|length }}": "1475310",
        "{% for g, xs in c|groupby('role') %}{{ g }}:{{ xs|length }} {% endfor %}": "u:2 v:1 ",
        "{% for g in c|groupby('role') %}{{ g.grouper }}{{ g.list|map(attribute='n')|join('+') }} {% endfor %}": "u3+2 v1 ",
        "{{ 'ab'|center(7) }}|{{ 'abc'|center(6) }}|": "   ab  | abc  |".replace("   ab  ", "ab".center(7)).replace(" abc  ","abc".center(6)),
        "{{ 1|filesizeformat }} {{ 999|filesizeformat }} {{ 1500|filesizeformat }} {{ 3000000|filesizeformat }} {{ 2048|filesizeformat(true) }}": "1 Byte 999 Bytes 1.5 kB 3.0 MB 2.0 KiB",
        "{{ 'a\\nb\\n\\nc'|indent }}|{{ 'a\\nb'|indent(2, true) }}": "a\n    b\n\n    c|  a\n  b",
        "{{ {'a': 1, 'b': none, 'c': '<'}|xmlattr }}": ' a="1" c="&lt;"',
        "{{ c[0]|attr('role') }}{{ '<'|forceescape }}": "u&lt;",
        "{{ 'naïve café'|wordcount }} {{ 'a*~b c/d'|urlencode }} {{ '  x '|trim }}|": "2 a%2A~b%20c/d x|",
        "{{ 'upper' is filter }}{{ 'nope' is filter }}{{ 'odd' is test }}{{ text is escaped }}": "TrueFalseTrueFalse",
        "{{ dict(a=1, b=text).b }}{{ c[0].get('n') }}{{ c[0].get('zz', 'd') }}{{ m.get('q', 0.5) }}{{ m.keys()|list|length }}": "hello3d0.52",
        "{% for ch in text %}{{ ch }}.{% endfor %}": "h.e.l.l.o.",
        "{{ names|join(', ') }}{% for x in c|map(attribute='n') %}{{ x }}{% endfor %}": "b, A, b312",
    }
    got = df.select(*[render(t, names).col.alias(f"c{i}") for i, t in enumerate(cases)]).first()
    wrong = {t: (g, w) for (t, w), g in zip(cases.items(), got, strict=True) if g != w}
    assert not wrong


def test_texts_of_values_inside_containers(spark):
    """The built-in form, used in loops, gives what Python's repr gives."""
    texts = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "\n\r\t\x00\x1f\x7f\x85\xa0\xad", "é日😀", "", None]
    rows = [(t, [t, "x"], (1, t, None, True), {"k": t}) for t in texts]
    df = spark.createDataFrame(rows, "t string, a array<string>, s struct<n:int,t:string,d:double,b:boolean>, m map<string,string>")
    for name in ("a", "s", "m"):
        got = df.select(pytext.py_repr(Value(F.col(name), df.schema[name].dataType)).alias("v"), name).collect()
        plain = lambda x: x.asDict() if hasattr(x, "asDict") else x
        assert [r["v"] for r in got] == [str(plain(r[name])) for r in got]


def test_macros_that_call_themselves_stop(names):
    with pytest.raises(UnsupportedTemplate, match="calls itself"):
        render("{% macro f(x) %}{{ f(x) }}{% endmacro %}{{ f(1) }}", names)
    with pytest.raises(TemplateError, match="takes 1 arguments"):
        render("{% macro f(x) %}{{ x }}{% endmacro %}{{ f(1, 2) }}", names)
    assert free_variables("{% macro f(x, y=text) %}{{ x }}{{ z }}{% endmacro %}{{ f(id) }}{% for k, v in c.items() %}{{ k }}{{ w }}{% endfor %}{% filter upper %}{{ q }}{% endfilter %}") == {"text", "z", "id", "c", "w", "q"}


def test_batch_and_slice(df, names):
    cases = {
        "{{ names|batch(2) }} ": "[['b', 'A'], ['b']] ", "{{ names|batch(2, 'z') }} ": "[['b', 'A'], ['b', 'z']] ", "{{ []|list|length }}{{ range(0)|batch(2)|list|length }}": "00",
        "{{ names|slice(2) }} ": "[['b', 'A'], ['b']] ", "{{ range(7)|slice(3) }} ": "[[0, 1, 2], [3, 4], [5, 6]] ", "{{ range(7)|slice(3, 9) }} ": "[[0, 1, 2], [3, 4, 9], [5, 6, 9]] ",
        "{{ range(2)|slice(3) }} ": "[[0], [1], []] ",
    }
    got = df.select(*[render(t, names).col.alias(f"c{i}") for i, t in enumerate(cases)]).first()
    wrong = {t: (g, w) for (t, w), g in zip(cases.items(), got, strict=True) if g != w}
    assert not wrong


def test_single_variable_keeps_its_type(df, names):
    assert single_variable("{{ c }}\n") == "c" and single_variable(" {{ c }}") is None and single_variable("{{ c|list }}") is None
    assert compile_template("{{ c }}", names).type == df.schema["c"].dataType
    assert compile_template("{{ c }}\n", names).type == df.schema["c"].dataType
    assert compile_template("{{ nope }}", names).type.simpleString() == "string"


def test_free_variables():
    source = "{% set a = b %}{{ a }}{% for x in c if x > d %}{{ x }}{{ loop.index }}{{ e.f }}{% endfor %}{% if g %}{{ h|default(i) }}{% endif %}{% with j = k %}{{ j }}{% endwith %}"
    assert free_variables(source) == {"b", "c", "d", "e", "g", "h", "i", "k"}
    assert free_variables("{a} {{ range(2) }}") == set()


@pytest.mark.parametrize("source", ["{{ a", "{% if a %}", "{{ a b }}", "{{ }}", "{{ 'x }}", "{% for x c %}{% endfor %}"])
def test_syntax_errors(source):
    with pytest.raises(TemplateError):
        templates.parse(source)


@pytest.mark.parametrize("source", ["{% include 'x' %}", "{% extends 'x' %}", "{{ text|pprint }}", "{{ text|nofilter }}", "{{ text is notest }}", "{{ lipsum() }}", "{% for a, b in c %}{% endfor %}", "{{ c[0].pop('n') }}", "{% for x in c %}{{ loop.nope }}{% endfor %}", "{{ text.encode() }}"])
def test_unsupported(names, source):
    with pytest.raises(UnsupportedTemplate):
        render(source, names)


def test_attribute_of_undefined(names):
    with pytest.raises(PlanError):
        render("{{ nope.x }}", names)


def test_method_names_are_fields(spark):
    df = spark.createDataFrame([((1,),)], "d struct<items:int>")
    with pytest.warns(UserWarning, match="field"):
        assert df.select(render("{{ d.items }}!", {"d": Value(F.col("d"), df.schema["d"].dataType)}).col).first()[0] == "1!"
