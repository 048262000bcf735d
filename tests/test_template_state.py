"""Templates whose loops carry state, recurse, or fill lines, against what the template language prints."""

import json
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import pytext, wrapping
from sparkloom.functions.templates import TemplateError, UnsupportedTemplate, free_variables, render
from sparkloom.functions.values import Value

LEAF = "struct<name:string,kids:array<struct<name:string>>>"
SCHEMA = f"n long, f double, text string, flag boolean, gone string, xs array<int>, names array<string>, c array<struct<role:string,n:int>>, tree array<struct<name:string,kids:array<{LEAF}>>>, d struct<b:int,a:int>"
ROW = (
    7, 1.5, "hello", True, None, [3, 1, 1, 2], ["b", "A"], [("u", 3), ("u", 1), ("v", 1)],
    [("a", [("b", [("c",), ("d",)]), ("e", [])]), ("f", None)], (1, 2),
)
TREE = "{% for t in tree recursive %}{{ t.name }}{{ loop.depth }}{% if t.kids %}({{ loop(t.kids) }}){% endif %}{% endfor %}"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW, (1, 0.1, "", False, "x", [], [], None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def names(df):
    return {f.name: Value(F.col(f.name), f.dataType) for f in df.schema.fields}


def check(df, names, cases):
    got = df.filter("n = 7").select(*[render(t, names).col.alias(f"c{i}") for i, t in enumerate(cases)]).first()
    wrong = {t: (g, w) for (t, w), g in zip(cases.items(), got, strict=True) if g != w}
    assert not wrong


def test_state(df, names):
    check(df, names, {
        "{% set ns = namespace(total=0, last='-') %}{% for x in xs %}{% set ns.total = ns.total + x %}{{ ns.total }} {% set ns.last = x ~ '!' %}{% endfor %}{{ ns.total }}{{ ns.last }}": "3 4 5 7 72!",
        "{% set ns = namespace(found=false) %}{% for m in c %}{% if m.role == 'v' %}{% set ns.found = true %}{% endif %}{% endfor %}{{ ns.found }}": "True",
        "{% set ns = namespace({'a': 1}, b=2) %}{% set ns.a = ns.b %}{{ ns.a }}{{ ns.b }}{{ ns.c }}|": "22|",
        "{% set ns = namespace(i=0) %}{% for x in xs %}{% for m in c if m.n < 3 %}{% set ns.i = ns.i + m.n * x %}{% endfor %}{{ ns.i }},{% endfor %}": "6,8,10,14,",
        "{% set ns = namespace(i=none) %}{% for x in xs %}{% if ns.i is none or x > ns.i %}{% set ns.i = x %}{% endif %}{% endfor %}{{ ns.i }}": "3",
        "{% set ns = namespace(s='') %}{% for k, v in d.items() %}{% set ns.s = ns.s ~ k ~ v %}{% endfor %}{{ ns.s }}": "b1a2",
        "{% set ns = namespace(n=0) %}{% for x in xs if x > 1 %}{% set ns.n = ns.n + 1 %}{% else %}none{% endfor %}{{ ns.n }}": "2",
        "{% set row = cycler('odd', 'even', 'x') %}{% for x in xs %}{{ row.next() }},{% endfor %}{{ row.current }}": "odd,even,x,odd,even",
        "{% set row = cycler(1, 2) %}{{ row.next() }}{{ row.next() }}{{ row.next() }}{{ row.reset() }}{{ row.current }}": "121None1",
        "{% set comma = joiner() %}{% for x in xs %}{{ comma() }}{{ x }}{% endfor %}": "3, 1, 1, 2",
        "{% set pipe = joiner('|') %}{% if flag %}{{ pipe() }}a{% endif %}{% if gone %}{{ pipe() }}b{% endif %}{{ pipe() }}c": "a|c",
        "{% for x in xs %}{% if loop.changed(x) %}{{ x }}{% endif %}{% endfor %}": "312", "{% for m in c %}{{ loop.changed(m.role, m.n) }} {% endfor %}": "True True True ",
        "{% for x in xs %}{% for m in c %}{{ 1 if loop.changed(m.role) else 0 }}{% endfor %} {% endfor %}": "101 101 101 101 ",
        "{% for x in xs %}{{ loop.previtem }}<{{ x }}>{{ loop.nextitem }} {% endfor %}": "<3>1 3<1>1 1<1>2 1<2> ",
        "{% for m in c %}{% if loop.previtem is defined and loop.previtem.role == m.role %}={% else %}{{ m.role }}{% endif %}{% endfor %}": "u=v",
        "{% for x in xs if x < 3 %}{{ loop.previtem|default('-') }}{{ x }} {% endfor %}": "-1 11 12 ", "{% for x in (1, 'a', 2.5) %}{{ loop.previtem }}{{ x }}{{ loop.nextitem }} {% endfor %}": "1a 1a2.5 a2.5 ",
    })


def test_empty_rows_keep_the_state_they_began_with(df, names):
    cases = {
        "{% set ns = namespace(n=5) %}{% for x in xs %}{% set ns.n = 0 %}{% endfor %}{{ ns.n }}": "5", "{% for m in c %}{% if loop.changed(m.n) %}x{% endif %}{% else %}-{% endfor %}": "-",
        TREE: "", "{% set k = namespace(n=1) %}{% for m in c %}{% set k.n = 2 %}{% else %}{% set k.n = 3 %}{% endfor %}{{ k.n }}": "3",
    }
    got = df.filter("n = 1").select(*[render(t, names).col for t in cases]).first()
    assert list(got) == list(cases.values())


def test_names_set_in_branches_outlive_them(df, names):
    check(df, names, {
        "{% if flag %}{% set k = 'a' %}{% else %}{% set k = 'b' %}{% endif %}{{ k }}": "a", "{% set k = 1 %}{% if not flag %}{% set k = 2 %}{% endif %}{{ k }}": "1",
        "{% if gone %}{% set k = 'a' %}{% endif %}[{{ k }}]{{ k is defined }}{{ k|default('-') }}": "[]False-", "{% if n > 1 %}{% set k = 'a' %}{% endif %}[{{ k }}]{{ k is defined }}{{ k|default('-') }}": "[a]Truea",
        "{% for x in xs %}{% set k = x %}{% endfor %}[{{ k }}]": "[]", "{% set a, b = n, text %}{{ b }}{{ a }}": "hello7", "{% if n > 9 %}{% set k = 'x' %}{% elif n > 5 %}{% set k = n %}{% endif %}{{ k }}": "7",
        "{% set k | upper | trim %} a{{ n }} {% endset %}{{ k }}": "A7",
    })
    assert free_variables("{% if a %}{% set k = 1 %}{% else %}{% set k = 2 %}{% endif %}{{ k }}{% if a %}{% set j = 1 %}{% endif %}{{ j }}{% set ns.x = y %}{{ joiner() }}") == {"a", "j", "ns", "y"}


def test_recursion(df, names):
    check(df, names, {
        TREE: "a1(b2(c3d3)e2)f1", "{% for t in tree recursive %}{{ loop.depth0 }}{{ t.name }}{{ loop(t.kids) if t.kids }}{% else %}-{% endfor %}": "0a1b2c2d1e0f",
        "{% macro show(t) %}{{ t.name }}{% for k in t.kids %}[{{ show(k) }}]{% endfor %}{% endmacro %}{% for t in tree %}{{ show(t) }};{% endfor %}": "a[b[c][d]][e];f;",
        "{% macro show(t) %}{{ t.name }}{% if t.kids is defined %}{{ all(t.kids) }}{% endif %}{% endmacro %}{% macro all(ts) %}{% for t in ts or [] %}<{{ show(t) }}>{% endfor %}{% endmacro %}{{ all(tree) }}": "<a<b<c><d>><e>><f>",
        "{% set ns = namespace(n=0) %}{% for t in tree recursive %}{% set ns.n = ns.n + 1 %}{% if t.kids %}{{ loop(t.kids) }}{% endif %}{% endfor %}{{ ns.n }}": "6",
        "{% for x in xs %}{% for m in c %}{{ loop.depth }}{% endfor %}{% endfor %}": "1" * 12,
    })
    with pytest.raises(UnsupportedTemplate, match="go down"):
        render("{% for t in tree recursive %}{{ loop(tree) }}{% endfor %}", names)
    with pytest.raises(UnsupportedTemplate, match="calls itself"):
        render("{% macro f(x) %}{{ g(x) }}{% endmacro %}{% macro g(x) %}{{ f(x) }}{% endmacro %}{{ f(c) }}", names)


def test_texts_of_tuples_and_numbers(df, names):
    check(df, names, {
        "{{ (n, f) }}": "(7, 1.5)", "{{ [n, f, [1, 2.0]] }}": "[7, 1.5, [1, 2.0]]", "{{ (n,) }}{{ () }}{{ 1, 'a' }}": "(7,)()(1, 'a')", "{{ {'a': n, 'b': (f, none)} }}": "{'a': 7, 'b': (1.5, None)}",
        "{{ d.items() }}{{ d|dictsort }}": "[('b', 1), ('a', 2)][('a', 2), ('b', 1)]", "{{ 7|round(2) }} {{ 7.26|round(1) }} {{ 1250|round(-2) }} {{ 7|round(0, 'ceil') }}": "7 7.3 1200 7.0",
        "{{ d|dictsort(by='value') }}{{ d|dictsort(false, 'value', true) }}": "[{'key': 'b', 'value': 1}, {'key': 'a', 'value': 2}][{'key': 'a', 'value': 2}, {'key': 'b', 'value': 1}]",
        "{% set m = {text: n, 'b': 2, text ~ '': 3} %}{{ m }}{{ m[text] }}{{ m.b }}{{ m|tojson }}{% for k, v in m.items() %}{{ k }}={{ v }};{% endfor %}": "{'hello': 3, 'b': 2}32{\"b\": 2, \"hello\": 3}hello=3;b=2;", "{% set k = 'a' %}{{ d[k] }}{{ c[0]['ro' ~ 'le'] }}": "2u",
        "{{ (n, f)|join(',') }} {{ (n, f)|first }} {{ [n, 'a']|last }} {{ [n, 'a']|length }} {{ 'a' in [n, 'a'] }} {{ 8 in (n, 'a') }} {{ []|first }}|": "7,1.5 7 a 2 True False |",
        "{{ xs|sum(start=10) }} {{ c|sum('n', 1) }} {{ c|sum(attribute='n', start=0.5) }}": "17 6 5.5", "{{ 7.5 // 2 }} {{ -7.5 // 2 }} {{ 7.5 % 2 }} {{ -7.5 % 2 }} {{ 7 // 2.0 }}": "3.0 -4.0 1.5 0.5 3.0",
        "{{ text[::-1] }} {{ text[::2] }} {{ xs[::-1] }} {{ xs[1::2] }} {{ text[4:0:-2] }}": "olleh hlo [2, 1, 1, 3] [1, 2] ol", "{{ (1, 'a', 2.5)[::-1] }}{{ [1, 'b'][-1] }}": "(2.5, 'a', 1)b",
    } | {"{{ d|dictsort(by='value') }}{{ d|dictsort(false, 'value', true) }}": "[('b', 1), ('a', 2)][('a', 2), ('b', 1)]"})


def test_text_methods(df, names):
    check(df, names, {
        "{{ text.upper() }}{{ ' a '.strip() }}|{{ 'xxaxx'.strip('x') }}{{ 'a.'.rstrip('.') }}{{ ' a'.lstrip() }}": "HELLO" "a|aaa", "{{ 'a b  c'.split() }}{{ 'a.b.c'.split('.') }}{{ 'a.b.c'.split('.', 1) }}": "['a', 'b', 'c']['a', 'b', 'c']['a', 'b.c']",
        "{% for p in 'k=v;w'.split(';') %}{{ p.split('=')[0] }},{% endfor %}": "k,w,", "{{ text.startswith('he') }}{{ text.endswith(('x', 'lo')) }}{{ text.replace('l', 'L') }}": "TrueTrueheLLo",
        "{{ 'aXbX'.count('X') }}{{ text.find('l') }}{{ text.find('z') }}{{ ', '.join(names) }}": "22-1b, A", "{{ 'ab'.removeprefix('a') }}{{ 'ab'.removesuffix('b') }}{{ 'ab'.capitalize() }}": "baAb",
        "{{ '12'.isdigit() }}{{ 'a1'.isalpha() }}{{ '-5'.zfill(4) }}{{ 'a\\nb\\n'.splitlines() }}": "TrueFalse-005['a', 'b']",
    })


def test_tojson(df, names):
    check(df, names, {
        "{{ d|tojson }}": '{"a": 2, "b": 1}', "{{ [n, f, 'é<😀\\n\"', none, true]|tojson }}": '[7, 1.5, "\\u00e9\\u003c\\ud83d\\ude00\\n\\"", null, true]',
        "{{ {'b': [], 'a': {'z': 1}}|tojson(indent=2) }}": json.dumps({"b": [], "a": {"z": 1}}, sort_keys=True, indent=2), "{{ c|tojson(1) }}": json.dumps([{"role": r, "n": n} for r, n in ROW[7]], sort_keys=True, indent=1),
        "{{ \"it's & so\"|tojson }}": '"it\\u0027s \\u0026 so"', "{{ 1e-7|tojson }}{{ xs|tojson }}": "1e-07[3, 1, 1, 2]",
    })


@pytest.mark.parametrize("source", ["{{ text|sum(strt=1) }}", "{{ text|trim(nope=1) }}", "{{ nope|tojson }}", "{% set text.x = 1 %}", "{% set j = joiner() %}{% for x in xs if j() %}{% endfor %}", "{{ text|wordwrap(0) }}", "{{ d|dictsort(by='x') }}", "{{ text[::0] }}"])
def test_wrong_arguments_are_template_errors(names, source):
    with pytest.raises(TemplateError):
        render(source, names)


def test_python_texts(spark):
    r = random.Random(4)
    floats = [r.choice([r.random(), r.random() * 1e18, r.random() * 10.0 ** r.randint(-300, 300), float(r.randint(0, 10**17)), round(r.random() * 100, 2), 2.0 ** r.randint(-1000, 60)]) for _ in range(4000)]
    floats += [0.0, -0.0, 5e-324, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 9007199254740993.0, 2e-3, 1e7, 1e-3]
    texts = ["", "a'b", 'a"b', "'\"", "a\\b\n\r\t\x00\x1f\x7f", "é\xa0\xad ​😀", "\U000e0001"]
    df = spark.createDataFrame([(i, x, texts[i % len(texts)]) for i, x in enumerate(floats)], "i int, x double, t string")
    got = df.select("x", "t", pytext.shortest(F.col("x")).alias("a"), pytext.py_repr(Value(F.col("t"), df.schema["t"].dataType)).alias("b"), pytext.json_text(F.col("t")).alias("c")).collect()
    wrong = [(x["x"], x["a"]) for x in got if repr(x["x"]) != x["a"]]
    assert not wrong
    assert all(x["b"] == repr(x["t"]) and x["c"] == json.dumps(x["t"]).replace("\x7f", "\\u007f") for x in got)


def test_values_are_written_without_python(df, names):
    plan = df.select(render("{{ f }} {{ c }} {{ (n, f) }} {{ d }} {{ tree|tojson }}", names).col)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, width, long, mark, hyphens):
    fill = lambda line: mark.join(textwrap.wrap(line, width=width, expand_tabs=False, replace_whitespace=False, break_long_words=long, break_on_hyphens=hyphens))
    return mark.join(map(fill, text.splitlines()))


@pytest.mark.parametrize(("width", "long", "mark", "hyphens"), [(79, True, "\n", True), (12, True, "\n", True), (7, True, "|", False), (7, False, "\n", True), (1, True, "\n", True), (5, False, "~", False)])
def test_wordwrap(spark, width, long, mark, hyphens):
    r = random.Random(width)
    pieces = ["a", "the", "well-known", "e-mail", "so--called", "x" * 30, "co-op-er-a-tion", "--", "-", "1-2-3", "über-groß", "don't", "a-b", "semi-été", "-" * 9, "word,", "(in)", "--dash", "long-" * 6]
    gaps = [" ", " ", " ", "  ", "\t", "      ", "\n", "\n\n", "\r\n", " \n ", " "]
    texts = ["".join(r.choice(pieces) + r.choice(gaps) for _ in range(r.randint(0, 25))) for _ in range(250)] + ["", " ", "   a", "\n", "a" * 100, " " * 40, "a " * 60]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", wrapping.wordwrap(F.col("t"), width, long, mark, hyphens).alias("w")).collect()
    wrong = [(x["t"], x["w"], want) for x in got if x["w"] != (want := wrapped(x["t"], width, long, mark, hyphens))]
    assert not wrong, wrong[0]


@pytest.mark.parametrize(("width", "hyphens"), [(60, True), (9, False), (2, True), (1, True)])
def test_plain_lines_are_filled_without_folds(spark, width, hyphens):
    """Words and single spaces, which most texts are, go by one expression, with what isn't plain told apart."""
    r = random.Random(width)
    words = ["a", "of", "the", "naïve", "𝒳𝒴", "x" * (width - 1 or 1), "y" * width, "in,", "don't"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(150)]
    odd = [t + x + t for t in texts[:30] for x in ("  ", "\xa0", "\u3000", "-", " - ", "\t", "z" * (width + 1))] + [" " + t for t in texts[:9]] + [t + " " for t in texts[:9]]
    df = spark.createDataFrame([(t,) for t in texts + odd], "t string")
    got = df.select("t", wrapping.wordwrap(F.col("t"), width, True, "\n", hyphens).alias("w"), wrapping._plain(F.col("t"), width, hyphens).alias("plain")).collect()
    wrong = [(x["t"], x["w"], want) for x in got if x["w"] != (want := wrapped(x["t"], width, True, "\n", hyphens))]
    assert not wrong, wrong[0]
    assert {x["t"] for x in got if x["plain"]} >= {t for t in texts if max(map(len, t.split())) <= width}


def test_urlize(df, names):
    rel = ' rel="noopener"'
    check(df, names, {
        "{{ 'see http://a.org/x?y=1&z, and (www.b.com).'|urlize }}": f'see <a href="http://a.org/x?y=1&amp;z"{rel}>http://a.org/x?y=1&amp;z</a>, and (<a href="https://www.b.com"{rel}>www.b.com</a>).',
        "{{ 'mail me@x.org or mailto:you@y.de!'|urlize }}": 'mail <a href="mailto:me@x.org">me@x.org</a> or mailto:you@y.de!',
        "{{ 'mailto:you@y.de'|urlize }}  {{ 'a.b c@d no.thing'|urlize }}": '<a href="mailto:you@y.de">you@y.de</a>  a.b c@d no.thing',
        "{{ 'https://en.org/w_(x) <https://e.org>'|urlize(12, true, target='_blank') }}": '<a href="https://en.org/w_(x)" rel="nofollow noopener" target="_blank">https://en.o...</a> &lt;<a href="https://e.org" rel="nofollow noopener" target="_blank">https://e.or...</a>&gt;',
        "{{ 'ftp://a tel:1 example.com 10.0.0.1 http://10.0.0.1:80/'|urlize(extra_schemes=['tel:'], rel='me') }}": 'ftp://a <a href="tel:1" rel="me noopener">tel:1</a> <a href="https://example.com" rel="me noopener">example.com</a> 10.0.0.1 <a href="http://10.0.0.1:80/" rel="me noopener">http://10.0.0.1:80/</a>',
        "{{ ''|urlize }}{{ ' a  b\n'|urlize }}": " a  b\n", "{{ '(http://x.org/(a))).'|urlize }}": f'(<a href="http://x.org/(a)"{rel}>http://x.org/(a)</a>)).',
    })


def test_random_picks_an_element(df, names):
    got = {r[0] for _ in range(20) for r in df.filter("n = 7").select(render("{{ xs|random }}!", names).col).collect()}
    assert got <= {"1!", "2!", "3!"} and len(got) > 1
