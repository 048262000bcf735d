"""Every registered query of the engine's own operators, and the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import sources
from sparkloom.functions.paths import compile_path
from sparkloom.functions.values import Value
from sparkloom.operators import shards
from sparkloom.operators.checkpoints import shared_folder
from sparkloom.plans.config import from_dict
from sparkloom.plans.rewrite import project, rewrite
from sparkloom.sources import arrow_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: DuckDB's side of :func:`conversations`.
_CONVERSATIONS = "(SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS c FROM conversations GROUP BY conv_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows to try paths on: each conversation with its turns in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    return turns


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _root(df: DataFrame) -> Value:
    return Value(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)


def _path(name: str, path: str, sql: str) -> None:
    """A query that evaluates one path over all conversations; ``sql`` is the same over ``c``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = conversations(spark, sf_dir)
        v = compile_path(path, _root(df))
        return df.select("conv_id", v.col.alias("v"))

    query(name, f"SELECT conv_id, {sql} AS v FROM {_CONVERSATIONS}")(run)


def _glued(xs: str, glue: str = "chr(10)") -> str:
    return f"coalesce(array_to_string({xs}, {glue}), '')"


_TEXTS = "list_filter(list_transform(c, lambda x: x.text), lambda t: t IS NOT NULL)"
_path("path_index", "c[0].text", "c[1].text")
_path("path_negative_index", "c[-1].role", "c[-1].role")
_path("path_out_of_range", "c[3].text", "c[4].text")
_path("path_projection_join", "join('\n', c[*].text)", _glued(_TEXTS))
_path("path_filter_length", "length(c[?role == 'user'])", "len(list_filter(c, lambda x: x.role = 'user'))::BIGINT")
_path("path_filter_and", "length(c[?role == 'user' && turn > `0`])", "len(list_filter(c, lambda x: x.role = 'user' AND x.turn > 0))::BIGINT")
_path("path_filter_or_not", "length(c[?role == 'system' || !(role == 'user')])", "len(list_filter(c, lambda x: x.role = 'system' OR x.role <> 'user'))::BIGINT")
_path("path_slice", "join(',', c[1:3].role)", _glued("list_transform(c[2:3], lambda x: x.role)", "','"))
_path("path_slice_reversed", "join(',', c[::-1].role)", _glued("list_reverse(list_transform(c, lambda x: x.role))", "','"))
_path("path_max_by", "max_by(c, &turn).text", "list_reverse(c)[1].text")
_path("path_min_by", "min_by(c, &turn).text", "c[1].text")
_path("path_sort_by", "join(',', sort_by(c, &role)[*].role)", _glued("list_sort(list_transform(c, lambda x: x.role))", "','"))
_path("path_max_min", "max(c[*].turn)", "list_max(list_transform(c, lambda x: x.turn))")
_path("path_sum", "sum(c[*].turn)", "list_sum(list_transform(c, lambda x: x.turn))::BIGINT")
_path("path_avg", "avg(c[*].turn)", "list_sum(list_transform(c, lambda x: x.turn))::DOUBLE / len(c)")
_path("path_contains", "contains(c[0].text, 'the')", "contains(c[1].text, 'the')")
_path("path_starts_with", "starts_with(c[0].role, 'us')", "starts_with(c[1].role, 'us')")
_path("path_or", "c[5].role || c[0].role", "coalesce(nullif(c[6].role, ''), c[1].role)")
_path("path_not_null", "not_null(c[7].role, c[1].role)", "coalesce(c[8].role, c[2].role)")
_path("path_pipe_flatten", "c[*].[role, text][] | [1]", "list_filter(flatten(list_transform(c, lambda x: [x.role, x.text])), lambda t: t IS NOT NULL)[2]")
_path("path_multiselect_hash", "{a: c[0].role, b: c[-1].role}.b", "c[-1].role")
_path("path_map_length", "length(map(&role, c))", "len(c)::BIGINT")
_path("path_reverse_text", "reverse(c[0].role)", "reverse(c[1].role)")
_path("path_type", "join(',', [type(c), type(c[1].turn), type(c[0].text)])", "'array,' || CASE WHEN c[2].turn IS NULL THEN 'null' ELSE 'number' END || ',' || CASE WHEN c[1].text IS NULL THEN 'null' ELSE 'string' END")
_path("path_to_number", "to_number(to_string(c[-1].turn))", "c[-1].turn::DOUBLE")
_path("path_abs_ceil_floor", "abs(ceil(avg(c[*].turn))) > floor(avg(c[*].turn))", "ceil(list_sum(list_transform(c, lambda x: x.turn))::DOUBLE / len(c)) > floor(list_sum(list_transform(c, lambda x: x.turn))::DOUBLE / len(c))")
_path("path_ends_with", "ends_with(c[-1].text, '.')", "ends_with(c[-1].text, '.')")
_path("path_keys", "join(',', sort(keys(c[0])))", "'role,text,turn'")
_path("path_values", "join('|', values({a: c[0].role, b: c[-1].role}))", "c[1].role || '|' || c[-1].role")
_path("path_merge", "join('|', values(merge({a: c[0].role, b: c[0].text}, {a: c[-1].role})))", "c[-1].role || '|' || c[1].text")
_path("path_min", "min(c[*].turn)", "list_min(list_transform(c, lambda x: x.turn))")
_path("path_sort", "join(',', sort(c[*].role))", _glued("list_sort(list_transform(c, lambda x: x.role))", "','"))
_path("path_to_array", "length(to_array(c[0].role)) < length(to_array(c))", "len(c) > 1")
_path("path_to_string", "to_string(c[0].turn)", "c[1].turn::VARCHAR")
_path("path_compare", "length(c[0].text) >= length(c[1].text)", "length(c[1].text) >= length(c[2].text)")
_path("path_mixed_list", "join(',', map(&type(@), [c[0].turn, c[0].role, c[9].role, c]))", "(CASE WHEN c[1].turn IS NULL THEN 'null' ELSE 'number' END) || ',' || (CASE WHEN c[1].role IS NULL THEN 'null' ELSE 'string' END) || ',' || (CASE WHEN c[10].role IS NULL THEN 'null' ELSE 'string' END) || ',array'")
_path("path_mixed_or", "to_string(c[5].role || c[0].turn)", "coalesce(nullif(c[6].role, ''), c[1].turn::VARCHAR)")
_path("path_mixed_values", "join('|', map(&to_string(@), values({a: c[-1].turn, b: c[-1].role})))", "c[-1].turn::VARCHAR || '|' || c[-1].role")
_path("path_object_wildcard", "join('|', map(&to_string(@), c[0].*))", "array_to_string(list_filter([c[1].turn::VARCHAR, c[1].role, c[1].text], lambda x: x IS NOT NULL), '|')")
_path("path_mixed_flatten", "length(c[*].[turn, role][] | [?type(@) == 'number'])", "len(list_filter(c, lambda x: x.turn IS NOT NULL))::BIGINT")


def rewritten(source: str, outputs: dict[str, Any], inputs: dict[str, str], derive: list[dict] = (), processors: list[dict] = (), remove: bool = True) -> Query:
    """A query that runs the whole rewriting plan over one table (or the nested conversations)."""
    raw = {
        "processors": list(processors),
        "processing_params": {"inputs": [{"name": n, "key": k} for n, k in inputs.items()], "outputs": list(derive), "output_schema": outputs, "remove_columns": remove},
    }

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = conversations(spark, sf_dir) if source == "nested" else table(spark, sf_dir, source)
        return rewrite(df, from_dict(raw))

    return run


_DOC = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n": "n_chars"}
query("template_text", "SELECT doc_id, 'Rewrite (' || lang || '): ' || text AS prompt FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "prompt": "Rewrite ({{ lang }}): {{ text }}"}, _DOC)
)
query("template_if", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'middle ' || lang ELSE 'short' END AS size FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "size": "{% if n > 2000 %}long{% elif n > 500 %}middle {{ lang }}{% else %}short{% endif %}"}, _DOC)
)
query(
    "template_for",
    f"SELECT conv_id, array_to_string(list_transform(c, lambda x, i: i::VARCHAR || '. ' || upper(x.role) || CASE WHEN i = len(c) THEN '' ELSE '; ' END), '') AS turns FROM {_CONVERSATIONS}",
)(rewritten("nested", {"conv_id": "{{ conv_id }}", "turns": "{% for m in c %}{{ loop.index }}. {{ m.role | upper }}{% if not loop.last %}; {% endif %}{% endfor %}"}, {"conv_id": "conv_id", "c": "c"}))
query("template_bool", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'True' ELSE 'False' END || ' ' || CASE WHEN lang = 'en' THEN 'True' ELSE 'False' END AS flags FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "flags": "{{ n is even }} {{ lang == 'en' }}"}, _DOC)
)
query(
    "template_filters",
    "SELECT doc_id, upper(lang) || '/' || replace(source, 'src', 'S') || '/' || length(text)::VARCHAR || '/' || reverse(lang) || '/' || (CASE WHEN contains(text, 'the') THEN 'yes' ELSE 'no' END) AS v FROM documents",
)(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ lang|upper }}/{{ source|replace('src', 'S') }}/{{ text|length }}/{{ lang|reverse }}/{{ 'yes' if 'the' in text else 'no' }}"}, _DOC))
query("template_arithmetic", "SELECT doc_id, (n_chars // 7)::VARCHAR || ' ' || (n_chars % 7)::VARCHAR || ' ' || (n_chars * 2 + 1)::VARCHAR AS v FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ n // 7 }} {{ n % 7 }} {{ n * 2 + 1 }}"}, _DOC)
)
query(
    "template_list_filters",
    f"SELECT conv_id, array_to_string(list_sort(list_transform(c, lambda x: x.role)), ',') || '|' || len(list_filter(c, lambda x: x.role = 'user'))::VARCHAR || '|' || c[1].role || '|' || c[-1].role AS v FROM {_CONVERSATIONS}",
)(
    rewritten(
        "nested",
        {"conv_id": "{{ conv_id }}", "v": "{{ c|map(attribute='role')|sort|join(',') }}|{{ c|selectattr('role', 'eq', 'user')|list|length }}|{{ (c|first).role }}|{{ (c|last).role }}"},
        {"conv_id": "conv_id", "c": "c"},
    )
)
query("template_set_with", "SELECT doc_id, lang || '-' || source || '!' || lang AS v FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{% set k = lang ~ '-' ~ source %}{{ k }}{% with z = lang %}!{{ z }}{% endwith %}{# no output #}"}, _DOC)
)


query(
    "template_text_filters",
    """SELECT doc_id, upper(lang[1]) || lower(lang[2:]) || '/' || length(lower(text))::VARCHAR || '/[' || ' ' || lang || ' ' || ']/' || lang || '/' || (CASE WHEN length(text) > 20 THEN text[1:17] || '...' ELSE text END)
       || '/' || replace(replace(replace(replace(replace(text[1:30], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), '"', '&#34;') || '/' || lang || '-007' AS v FROM documents""",
)(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ lang|capitalize }}/{{ text|lower|length }}/[{{ lang|center(4) }}]/{{ (' ' ~ lang ~ ' ')|trim }}/{{ text|truncate(20, true, '...', 0) }}/{{ text[:30]|escape }}/{{ '%s-%03d'|format(lang, 7) }}"}, _DOC)
)
query(
    "template_number_filters",
    "SELECT doc_id, n_chars::VARCHAR || ' ' || (n_chars / 4)::DOUBLE::VARCHAR || ' ' || (n_chars // 3)::VARCHAR || ' ' || floor(n_chars / 10)::DOUBLE::VARCHAR || ' ' || length(n_chars::VARCHAR)::VARCHAR || ' ' || n_chars::VARCHAR || ' d ' || (n_chars * 2)::VARCHAR AS v FROM documents",
)(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ (-n)|abs }} {{ n / 4 }} {{ (n / 3)|int }} {{ (n / 10)|round(0, 'floor') }} {{ n|string|length }} {{ n|string|int(9) }} {{ missing|default('d') }} {{ [n, n]|sum }}"}, _DOC))
query(
    "template_sequence_filters",
    f"""SELECT conv_id, list_max(list_transform(c, lambda x: x.turn))::VARCHAR || ' ' || list_min(list_transform(c, lambda x: x.turn))::VARCHAR || ' ' || list_sum(list_transform(c, lambda x: x.turn))::VARCHAR
        || ' ' || len(list_distinct(list_transform(c, lambda x: x.role)))::VARCHAR || ' ' || len(list_filter(c, lambda x: x.turn <> 0))::VARCHAR || ' ' || len(list_filter(c, lambda x: x.turn = 0))::VARCHAR
        || ' ' || len(list_filter(c, lambda x: x.role <> 'user'))::VARCHAR || ' ' || ((len(c) + 1) // 2)::VARCHAR || ' 3' AS v FROM {_CONVERSATIONS}""",
)(
    rewritten(
        "nested",
        {"conv_id": "{{ conv_id }}", "v": "{% set t = c|map(attribute='turn')|list %}{{ t|max }} {{ t|min }} {{ t|sum }} {{ c|map(attribute='role')|unique|list|length }} {{ t|select|list|length }} {{ t|reject|list|length }} {{ c|rejectattr('role', 'eq', 'user')|list|length }} {{ c|batch(2)|list|length }} {{ c|slice(3)|list|length }}"},
        {"conv_id": "conv_id", "c": "c"},
    )
)
query(
    "template_groupby",
    f"SELECT conv_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(c, lambda x: x.role))), lambda r: r || '=' || len(list_filter(c, lambda x: x.role = r))::VARCHAR), ';'), '') AS v FROM {_CONVERSATIONS}",
)(rewritten("nested", {"conv_id": "{{ conv_id }}", "v": "{% for role, own in c|groupby('role') %}{{ ';' if not loop.first }}{{ role }}={{ own|length }}{% endfor %}"}, {"conv_id": "conv_id", "c": "c"}))
query(
    "template_unpacking",
    f"SELECT conv_id, 'turn=' || c[1].turn::VARCHAR || ',role=' || c[1].role || ',|role:' || c[1].role || ' turn:' || c[1].turn::VARCHAR || ' ' AS v FROM {_CONVERSATIONS}",
)(
    rewritten(
        "nested",
        {"conv_id": "{{ conv_id }}", "v": "{% for k, v in c[0].items() if k != 'text' %}{{ k }}={{ v }},{% endfor %}|{% for k, v in c[0]|dictsort if k != 'text' %}{{ k }}:{{ v }} {% endfor %}"},
        {"conv_id": "conv_id", "c": "c"},
    )
)
query(
    "template_nested_values",
    f"SELECT conv_id, array_to_string(list_transform(c, lambda x, i: replace('{{~role~: ~' || x.role || '~, ~turn~: ', '~', chr(39)) || x.turn::VARCHAR || '}}' || (x.turn / 4)::DOUBLE::VARCHAR || CASE WHEN i % 2 = 1 THEN 'a' ELSE 'b' END), '') AS v FROM {_CONVERSATIONS}",
)(rewritten("nested", {"conv_id": "{{ conv_id }}", "v": "{% for m in c %}{{ {'role': m.role, 'turn': m.turn} }}{{ m.turn / 4 }}{{ loop.cycle('a', 'b') }}{% endfor %}"}, {"conv_id": "conv_id", "c": "c"}))
query("template_macros", "SELECT doc_id, '<' || lang || '|x><' || source || '|' || n_chars::VARCHAR || '>[in ' || upper(lang) || ']' AS v FROM documents")(
    rewritten(
        "documents",
        {"doc_id": "{{ doc_id }}", "v": "{% macro tag(a, b='x') %}<{{ a }}|{{ b }}>{% endmacro %}{% macro box() %}[{{ caller() }}]{% endmacro %}{{ tag(lang) }}{{ tag(source, b=n) }}{% call box() %}in {% filter upper %}{{ lang }}{% endfilter %}{% endcall %}"},
        _DOC,
    )
)
_TRUTHS = "list_transform([{}], lambda b: CASE WHEN b THEN '1' ELSE '0' END)"
query(
    "template_tests",
    "SELECT doc_id, array_to_string(" + _TRUTHS.format(
        "n_chars % 2 = 1, n_chars % 3 = 0, n_chars > 900, n_chars >= 900, n_chars < 900, n_chars <= 900, n_chars <> 900, lang IN ('en', 'de'), true, true, true, false, false, true, false, true, true, text = lower(text) AND text <> upper(text), lang = 'en', false, true"
    ) + ", '') AS v FROM documents",
)(
    rewritten(
        "documents",
        {"doc_id": "{{ doc_id }}", "v": "".join(f"{{{{ 1 if {x} else 0 }}}}" for x in (
            "n is odd", "n is divisibleby 3", "n is gt 900", "n is ge 900", "n is lt 900", "n is le 900", "n is ne 900", "lang is in ['en', 'de']", "lang is string", "n is number", "n is integer",
            "n is float", "lang is mapping", "text is sequence", "lang is none", "text is iterable", "lang is defined", "text is lower", "lang is sameas 'en'", "lang is escaped", "'upper' is filter",
        ))},
        _DOC,
    )
)


def _nested(name: str, template: str, sql: str, tree: str | None = None) -> None:
    """A query that renders one template over all conversations; ``sql`` is the same over ``c``."""
    inputs = {"conv_id": "conv_id", "c": "c"} | ({"tree": tree} if tree else {})
    query(name, f"SELECT conv_id, {sql} AS v FROM {_CONVERSATIONS}")(rewritten("nested", {"conv_id": "{{ conv_id }}", "v": template}, inputs))


def _each(text: str) -> str:
    return f"array_to_string(list_transform(c, lambda x, i: {text}), '')"


_nested(
    "template_namespace", "{% set ns = namespace(total=0) %}{% for m in c %}{% set ns.total = ns.total + m.turn %}{{ ns.total }},{% endfor %}={{ ns.total }}",
    _each("list_sum(list_transform(c[1:i], lambda y: y.turn))::VARCHAR || ','") + " || '=' || list_sum(list_transform(c, lambda x: x.turn))::VARCHAR",
)
_nested("template_cycler", "{% set k = cycler('a', 'b', 'c') %}{% for m in c %}{{ k.next() }}{{ m.turn }}{% endfor %}{{ k.current }}", _each("['a', 'b', 'c'][(i - 1) % 3 + 1] || x.turn::VARCHAR") + " || ['a', 'b', 'c'][len(c) % 3 + 1]")
_nested(
    "template_joiner", "{% set j = joiner('; ') %}{% for m in c %}{% if m.role == 'user' %}{{ j() }}{{ m.turn }}{% endif %}{% endfor %}",
    "coalesce(array_to_string(list_transform(list_filter(c, lambda x: x.role = 'user'), lambda x: x.turn), '; '), '')",
)
_nested("template_loop_changed", "{% for m in c %}{% if loop.changed(m.role) %}[{{ m.role }}]{% endif %}.{% endfor %}", _each("CASE WHEN i = 1 OR c[i - 1].role IS DISTINCT FROM x.role THEN '[' || x.role || ']' ELSE '' END || '.'"))
_nested(
    "template_neighbours", "{% for m in c %}{{ loop.previtem.turn if loop.previtem is defined else '-' }}<{{ m.turn }}>{{ loop.nextitem.turn if loop.nextitem is defined else '-' }} {% endfor %}",
    _each("(CASE WHEN i = 1 THEN '-' ELSE c[i - 1].turn::VARCHAR END) || '<' || x.turn::VARCHAR || '>' || coalesce(c[i + 1].turn::VARCHAR, '-') || ' '"),
)
_nested(
    "template_recursive_loop", "{% for t in tree recursive %}{{ loop.depth }}{{ t.name }}{% if t.kids %}({{ loop(t.kids) }}){% endif %}{% endfor %}",
    "'1root(' || " + _each("'2' || x.role || '(3' || x.turn::VARCHAR || ')'") + " || ')'", "[{name: 'root', kids: c[*].{name: role, kids: [{name: to_string(turn)}]}}]",
)
_nested(
    "template_recursive_macro", "{% macro show(t) %}<{{ t.name }}{% for k in t.kids %}{{ show(k) }}{% endfor %}>{% endmacro %}{{ show(tree[0]) }}",
    "'<root' || " + _each("'<' || x.role || '<' || x.turn::VARCHAR || '>>'") + " || '>'", "[{name: 'root', kids: c[*].{name: role, kids: [{name: to_string(turn)}]}}]",
)
query(
    "template_python_texts",
    "SELECT doc_id, (n_chars / 7)::VARCHAR || ' (' || n_chars::VARCHAR || ', ' || (n_chars / 8)::VARCHAR || ') {' || replace('~k~: ~' || lang || '~, ~v~: [', '~', chr(39)) || n_chars::VARCHAR || ', None]}' AS v FROM documents",
)(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ n / 7 }} {{ (n, n / 8) }} {{ {'k': lang, 'v': [n, none]} }}"}, _DOC))
query(
    "template_tojson",
    """SELECT doc_id, '{"big": ' || (n_chars > 900)::VARCHAR || ', "lang": "' || lang || '", "n": ' || n_chars::VARCHAR || ', "parts": ["' || source || '", ' || (n_chars / 4)::VARCHAR || ', "\\u00e9\\u003c"]}' AS v FROM documents""",
)(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ {'n': n, 'lang': lang, 'big': n > 900, 'parts': [source, n / 4, 'é<']}|tojson }}"}, _DOC))
query(
    "template_text_methods",
    """SELECT doc_id, upper(lang) || ' ' || reverse(source) || ' ' || len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::VARCHAR || ' ' || (CASE WHEN starts_with(text, 'the') THEN 'True' ELSE 'False' END)
       || ' ' || lpad(replace(source, 'src', ''), 3, '0') || ' ' || floor(n_chars / 2.5)::DOUBLE::VARCHAR || ' ' || ((length(text) - length(replace(text, 'the', ''))) // 3)::VARCHAR AS v FROM documents""",
)(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ lang.upper() }} {{ source[::-1] }} {{ text.split()|length }} {{ text.startswith('the') }} {{ source.removeprefix('src').zfill(3) }} {{ n // 2.5 }} {{ text.count('the') }}"}, _DOC)
)
query(
    "template_names_in_branches",
    "SELECT doc_id, (CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN n_chars::VARCHAR ELSE '' END) || '|' || (CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END) AS v FROM documents",
)(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{% if n > 2000 %}{% set size = 'long' %}{% elif n > 500 %}{% set size = n %}{% endif %}{{ size }}|{{ size is defined }}"}, _DOC))
query(
    "template_more_filters",
    """SELECT doc_id, n_chars::DOUBLE::VARCHAR || ' ' || upper(lang[1]) || lower(lang[2:]) || ' ' || source || '%20x 3 ' || lang || ' ' || lang || ' ' || lang || ' &lt;' || lang || chr(10) || '  b  a="' || lang || '" '
       || n_chars::VARCHAR || ' a=' || lang || ';b=1;0369' || source || ' 7 7.3 1200 ' || (n_chars * 2 + 10)::VARCHAR AS v FROM documents""",
)(
    rewritten(
        "documents",
        {"doc_id": "{{ doc_id }}", "v": "{{ n|float }} {{ lang|title }} {{ (source ~ ' x')|urlencode }} {{ 'a b c'|wordcount }} {{ ('<b>' ~ lang ~ '</b>')|striptags }} {{ lang|safe }} {{ {'a': lang}|attr('a') }} {{ ('<' ~ lang)|forceescape }}{{ '\nb'|indent(2) }} "
         "{{ {'a': lang}|xmlattr }} {{ n|round }} {% for k, v in {'a': lang, 'b': 1}|items %}{{ k }}={{ v }};{% endfor %}{% for i in range(0, 10, 3) %}{{ i }}{% endfor %}{{ dict(a=n, b=source).b }} {{ 7|round(2) }} {{ 7.26|round(1) }} {{ 1250|round(-2) }} {{ [n, n]|sum(start=10) }}"},
        _DOC,
    )
)
query(
    "template_more_tests",
    "SELECT doc_id, array_to_string(" + _TRUTHS.format("true, true, false, n_chars > 900, n_chars <= 900, true, true, false, true") + ", '') AS v FROM documents",
)(
    rewritten(
        "documents",
        {"doc_id": "{{ doc_id }}", "v": "".join(f"{{{{ 1 if {x} else 0 }}}}" for x in (
            "nope is undefined", "(n > 5) is boolean", "lang is callable", "(n > 900) is true", "(n > 900) is false", "lang|upper is upper", "'odd' is test", "'nope' is test", "n is even or n is odd",
        ))},
        _DOC,
    )
)
query("template_wordwrap")(rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ text|wordwrap(60) }}"}, _DOC))
query("template_urlize", """SELECT page_id, 'See <a href="' || replace(url, '&', '&amp;') || '" rel="noopener">' || replace(url, '&', '&amp;') || '</a>, (or <a href="mailto:me@' || page_id::VARCHAR || '.org">me@' || page_id::VARCHAR || '.org</a>).' AS v FROM pages""")(
    rewritten("pages", {"page_id": "{{ id }}", "v": "{{ ('See ' ~ url ~ ', (or me@' ~ id ~ '.org).')|urlize }}"}, {"id": "page_id", "url": "url"})
)


@query("output_struct_json", "SELECT doc_id, to_json([{'role': 'user', 'content': lang}, {'role': 'assistant', 'content': source}])::VARCHAR AS conversations FROM documents")
def output_struct_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    names = {n: _root(df).field(n) for n in df.columns}
    made = project([{"role": "user", "content": "{{ lang }}"}, {"role": "assistant", "content": "{{ source }}"}], names)
    return df.select("doc_id", F.to_json(made.col).alias("conversations"))


query("keep_and_override", "SELECT doc_id, lang, source, n_chars, 'T: ' || text AS text, 'x' AS extra FROM documents")(
    rewritten("documents", {"text": "T: {{ text }}", "extra": "x"}, {"text": "text"}, remove=False)
)
query("drop_columns", "SELECT text AS body FROM documents")(rewritten("documents", {"body": "{{ text }}"}, {"text": "text"}))
query("literal_leaf", "SELECT doc_id, 5::BIGINT AS five, true AS yes, 2.5::DOUBLE AS half, NULL::VARCHAR AS nothing FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "five": 5, "yes": True, "half": 2.5, "nothing": None}, _DOC)
)
query("undefined_renders_empty", "SELECT doc_id, '[' || ']' || lang AS v FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "[{{ no_such_name }}]{{ lang }}"}, _DOC)
)


_STUB = [{"type": "llm", "backend": "stub"}]


@query("keep_clashing_names", """SELECT doc_id, lang AS "__variables", source AS "__text", n_chars AS "__row", md5('Say: ' || source) AS a FROM documents""")
def keep_clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose columns have names that the plan uses itself."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("__variables"), F.col("source").alias("__text"), F.col("n_chars").alias("__row"))
    raw = {"inputs": [{"name": "s", "key": "__text"}], "outputs": [{"name": "a", "type": "llm", "prompt": "Say: {{ s }}"}], "output_schema": {"a": "{{ a }}"}}
    return rewrite(df, from_dict({"processors": _STUB, "processing_params": raw}))


@query("json_struct_parse", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_struct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("parsed", F.from_json("props", "k long", {"mode": "FAILFAST"}))
    return df.select("event_id", compile_path("parsed.k", _root(df)).col.alias("k"))


@query("json_variant_parse", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_variant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into a VARIANT column, whose types are known in each row only."""
    df = table(spark, sf_dir, "events").withColumn("parsed", F.parse_json("props"))
    return df.select("event_id", compile_path("to_number(parsed.k)", _root(df)).col.cast("long").alias("k"))


query("generate_plain_stub", "SELECT doc_id, md5('Say: ' || text) AS answer FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "answer": "{{ a }}"}, _DOC, [{"name": "a", "type": "llm", "prompt": "Say: {{ text }}"}], _STUB)
)
query(
    "generate_json_stub",
    "SELECT doc_id, 'question:' || md5('Ask: ' || text) AS question, 'A: answer:' || md5('Ask: ' || text) AS answer FROM documents",
)(
    rewritten(
        "documents", {"doc_id": "{{ doc_id }}", "question": "{{ a.question }}", "answer": "A: {{ a.answer }}"}, _DOC,
        [{"name": "a", "type": "llm", "output_type": "JSON", "output_schema": ["question", "answer"], "prompt": "Ask: {{ text }}"}], _STUB,
    )
)
query("chained_outputs", "SELECT doc_id, md5(md5(text)) AS v FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ b }}"}, _DOC, [{"name": "a", "type": "llm", "prompt": "{{ text }}"}, {"name": "b", "type": "llm", "prompt": "{{ a }}"}], _STUB)
)
query("expression_outputs", "SELECT doc_id, upper(lang) || ':' || source AS v FROM documents")(
    rewritten("documents", {"doc_id": "{{ doc_id }}", "v": "{{ b }}"}, _DOC, [{"name": "a", "type": "expr", "template": "{{ lang|upper }}"}, {"name": "b", "type": "expr", "template": "{{ a }}:{{ source }}"}])
)


@query("shard_contiguous", "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS __position, (ntile(7) OVER (ORDER BY doc_id) - 1)::INTEGER AS __shard FROM documents")
def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_shard(table(spark, sf_dir, "documents"), 7, order="doc_id")


@query("shard_strided", "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS __position, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INTEGER AS __shard FROM documents")
def shard_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_shard(table(spark, sf_dir, "documents"), 7, "strided", "doc_id")


@query("merge_by_name", "SELECT doc_id, lang, NULL::VARCHAR AS source FROM documents UNION ALL BY NAME SELECT source, doc_id, NULL::VARCHAR AS lang FROM documents")
def merge_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return shards.concat([df.select("doc_id", "lang"), df.select("source", "doc_id")])


@query("shard_merge_identity", "SELECT * FROM documents")
def shard_merge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    index = shards.key_index(df, "doc_id")  # counted once for the three
    return shards.concat([shards.shard(df, 3, i, index=index) for i in range(3)])


@query("shard_by_file_index", "SELECT *, (ntile(5) OVER (ORDER BY doc_id) - 1)::INTEGER AS shard FROM documents")
def shard_by_file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by place in the files of a Parquet folder. (The folder is written in order of the id.)"""
    path, docs = _scratch(spark), table(spark, sf_dir, "documents")
    docs.repartitionByRange(shards.pieces(docs.count(), 4), "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    df, index = spark.read.parquet(path), shards.file_index(spark, path)
    return shards.concat([shards.shard(df, 5, i, index=index).withColumn("shard", F.lit(i)) for i in range(5)])


@query("merge_in_order", "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS position FROM documents")
def merge_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in merged Parquet: shard after shard, each in its own order."""
    df, path = table(spark, sf_dir, "documents"), _scratch(spark)
    index = shards.key_index(df, "doc_id")
    for i in range(4):
        files = shards.pieces(index.total // 4, i + 1)
        shards.write_shard(spark, shards.shard(df, 4, i, index=index).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id"), f"{path}/in", i, 4)
    shards.merge(spark, f"{path}/in", f"{path}/out")
    return shards.file_index(spark, f"{path}/out").numbered(spark.read.parquet(f"{path}/out"), "position")


@query("merge_skips_bad_shards", "SELECT * FROM documents WHERE doc_id % 3 = 1")
def merge_skips_bad_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three shards one wasn't finished and one has no rows."""
    df, path = table(spark, sf_dir, "documents"), _scratch(spark)
    for i, rows in enumerate((df.filter("doc_id % 3 = 0"), df.filter("doc_id % 3 = 1"), df.limit(0))):
        shards.write_shard(spark, rows, f"{path}/in", i, 3)
    shards.delete(spark, f"{path}/in/shard_0/_SUCCESS")
    shards.merge(spark, f"{path}/in", f"{path}/out")
    return shards.read_shard(spark, f"{path}/out")


@query("split_counts", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split of a dataset."""
    df = table(spark, sf_dir, "documents")
    return spark.createDataFrame([(name, sources.rows(t)) for name, t in {"a": df.filter("doc_id % 3 = 0"), "b": df.filter("doc_id % 3 <> 0")}.items()], "split string, n long")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"


@query("source_jsonl", "SELECT * FROM documents")
def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "documents"), _scratch(spark)
    df.write.json(path)
    return sources.load(spark, sources.JsonlConfig(path)).select(*df.columns)


@query("source_jsonl_splits", "SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM documents")
def source_jsonl_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = table(spark, sf_dir, "documents"), _scratch(spark)
    df.filter("doc_id % 2 = 0").write.json(f"{path}/even")
    df.filter("doc_id % 2 <> 0").write.json(f"{path}/odd")
    data = sources.load(spark, sources.JsonlConfig({"even": f"{path}/even", "odd": f"{path}/odd"}, schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)))
    return shards.concat([t.withColumn("split", F.lit(name)) for name, t in data.items()])


@query("source_saved_dataset", "SELECT * FROM documents")
def source_saved_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    arrow_dir.write(table(spark, sf_dir, "documents"), path)
    return sources.load(spark, sources.ArrowDirConfig(path))


@query("source_failures_are_left_out", "SELECT * FROM conversations")
def source_failures_are_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [sources.ParquetConfig(f"{sf_dir}/no_such_table.parquet"), sources.ParquetConfig(f"{sf_dir}/conversations.parquet")]
    return sources.load_all(spark, wanted)[0][1]


@query("dataset_rows", "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations) AS n")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = {name: table(spark, sf_dir, name) for name in ("documents", "conversations")}
    return spark.createDataFrame([(sources.rows(data),)], "n long")


def _merged(kind: str, splits: bool) -> Query:
    """Shards written to disk, each by a job of its own, found and merged again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, path = table(spark, sf_dir, "documents"), _scratch(spark)
        index = shards.key_index(df, "doc_id")
        for i in range(3):
            part = shards.shard(df, 3, i, index=index)
            shards.write_shard(spark, {"train": part, "test": part.filter("doc_id < 100")} if splits else part, f"{path}/in/docs", i, 3, kind)
        shards.merge(spark, f"{path}/in", f"{path}/out", kind)
        whole = shards.read_shard(spark, f"{path}/out/docs")
        return shards.concat([t.withColumn("split", F.lit(n)) for n, t in whole.items()]) if splits else whole

    return run


query("merge_from_disk", "SELECT * FROM documents")(_merged("parquet", False))
query("merge_saved_datasets", "SELECT * FROM documents")(_merged("loadable", False))
query("merge_splits", "SELECT *, 'train' AS split FROM documents UNION ALL SELECT *, 'test' AS split FROM documents WHERE doc_id < 100")(_merged("parquet", True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as two-message conversations, with one generated variable."""
    return rewritten(
        "documents",
        {"doc_id": "{{ doc_id }}", "user": "{{ qa.question }}", "assistant": "{{ qa.answer }}", "prompt": "Rewrite ({{ lang }}): {{ text }}"},
        _DOC,
        [{"name": "qa", "type": "llm", "output_type": "JSON", "output_schema": ["question", "answer"], "prompt": "One question on:\n{{ text }}"}],
        _STUB,
    )(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
