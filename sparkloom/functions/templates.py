"""Text templates (Jinja), parsed on the driver and compiled to Columns.

Supported: text, ``{{ }}`` with attributes, items, arithmetic, comparisons,
``and or not in``, inline ``if``, ``~``, filters and tests, methods of texts and dictionaries; comments, ``raw``,
white space control; ``if``/``elif``/``else``, ``for`` over arrays, maps, lists of mixed
types and the items of structs (with ``if``, ``else``, unpacking, ``recursive`` and ``loop``), ``set``, ``with``,
``filter``, ``macro`` and ``call``; ``namespace``, ``cycler`` and ``joiner``. All else is an error when the template is
compiled. Names that are not variables are undefined and print nothing.

What is known when the template is compiled is worked out then: macros are inlined,
loops over the fields of a struct or over a list of the template are unrolled, and recursion
is unrolled along the type of what it goes over, which ends with the type.

Most loops become a ``transform`` of the array. A loop that leaves something behind for its next round (an attribute
of a namespace, the turn of a cycler, what ``loop.changed`` compares with) becomes an ``aggregate``, whose accumulator holds
the text so far and that state; what a branch leaves behind is chosen by the branch's condition.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import pytext, wrapping
from sparkloom.functions.paths import equal
from sparkloom.functions import values as V
from sparkloom.functions.values import Mixed, PlanError, Value


class TemplateError(PlanError):
    """A template that can't be parsed or planned."""


class UnsupportedTemplate(TemplateError):
    """A construct of the template language that has no Column form here."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


_OPENING = re.compile(r"\{[#{%]")
_INSIDE = re.compile(r"""(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<end>\}\}|%\})|(?P<open>[\[({])|(?P<close>[\])}])|.""", re.DOTALL)
_KINDS = {"{#": ("comment", "#}"), "{{": ("out", "}}"), "{%": ("block", "%}")}
_RAW = re.compile(r"\{%[-+]?\s*raw\s*(-?)%\}(.*?)\{%(-?)\s*endraw\s*(-?)%\}", re.DOTALL)
_TOKEN = re.compile(
    r"""\s+|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)
    |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~<>=.,:|()\[\]{}])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class _Tag:
    kind: str
    body: str
    start: int
    end: int


def _tag(source: str, at: int) -> _Tag | None:
    """The next tag that is closed. What closes it isn't looked for in texts and brackets inside."""
    for opening in _OPENING.finditer(source, at):
        kind, close = _KINDS[opening[0]]
        if kind == "comment":
            end = source.find(close, opening.end())
            if end >= 0:
                return _Tag(kind, source[opening.end() : end], opening.start(), end + 2)
            continue
        depth, place = 0, opening.end()
        while place < len(source):
            m = _INSIDE.match(source, place)
            if m["end"] == close and not depth:
                return _Tag(kind, source[opening.end() : m.start()], opening.start(), m.end())
            if m["end"]:  # brackets that happen to stand together
                depth, place = depth - (m["end"] == "}}"), place + 1
                continue
            depth += bool(m["open"]) - bool(m["close"])
            place = m.end()
    return None


def _pieces(source: str) -> list[tuple[str, str]]:
    """Text, output and block pieces, white space control applied."""
    source = source[:-1] if source.endswith("\n") else source
    out: list[list[str]] = []
    trim = False

    def text(t: str) -> None:
        nonlocal trim
        out.append(["text", t.lstrip() if trim else t])
        trim = False

    at = 0
    while at < len(source):
        raw, tag = _RAW.search(source, at), _tag(source, at)
        if raw and (not tag or raw.start() <= tag.start):
            text(source[at : raw.start()])
            if source[raw.start() + 2] == "-":
                out[-1][1] = out[-1][1].rstrip()
            body = raw[2].lstrip() if raw[1] else raw[2]
            out.append(["text", body.rstrip() if raw[3] else body])
            trim, at = bool(raw[4]), raw.end()
            continue
        if not tag:
            text(source[at:])
            break
        text(source[at : tag.start])
        body = tag.body
        if body.startswith("-"):
            out[-1][1] = out[-1][1].rstrip()
        trim = body.endswith("-") and len(body) > 1 or body == "-"
        body = body[1:] if body[:1] in ("-", "+") else body
        body = body[:-1] if trim and body.endswith("-") else body
        if tag.kind != "comment":
            out.append([tag.kind, body])
        at = tag.end
    rest = "".join(t for k, t in out if k == "text")
    if "{{" in rest and not _RAW.search(source):
        raise TemplateError(f"an output tag isn't closed in {source!r}")
    return [(k, t) for k, t in out if t or k != "text"]


def _unescaped(text: str) -> str:
    """A text between quotes; it may hold line breaks."""
    return text[1:-1].encode("ascii", "backslashreplace").decode("unicode-escape")


class _Expression:
    """Parses what stands inside a tag."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at]!r} in {text!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))

    def peek(self, *wanted: str) -> bool:
        kind, text = self.tokens[self.at]
        return kind in ("op", "name") and text in wanted

    def take(self, *wanted: str) -> str | None:
        if not self.peek(*wanted):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r} before {self.tokens[self.at][1]!r} in {self.text!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"expected a name before {text!r} in {self.text!r}")
        self.at += 1
        return text

    def done(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")

    def whole(self) -> Node:
        node = self.listed()
        self.done()
        return node

    def listed(self) -> Node:
        """An expression, or several with commas between them: a tuple."""
        items, comma = [self.expression()], False
        while comma := bool(self.take(",")):
            if self.tokens[self.at][0] == "end":
                break
            items.append(self.expression())
        return items[0] if len(items) == 1 and not comma else Node("tuple", parts=tuple(items))

    def expression(self) -> Node:
        node = self.either()
        while self.take("if"):
            condition = self.either()
            node = Node("inline_if", parts=(condition, node, self.expression() if self.take("else") else Node("undefined")))
        return node

    def _left(self, deeper, *ops: str) -> Node:
        node = deeper()
        while op := self.take(*ops):
            node = Node("binary", op, (node, deeper()))
        return node

    def either(self) -> Node:
        return self._left(self.both, "or")

    def both(self) -> Node:
        return self._left(self.negated, "and")

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node, pairs = self.added(), []
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                pairs.append((op, self.added()))
            elif self.peek("not") and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                pairs.append(("not in", self.added()))
            else:
                break
        out, left = None, node
        for op, right in pairs:
            this = Node("binary", op, (left, right))
            out, left = this if out is None else Node("binary", "and", (out, this)), right
        return out or node

    def added(self) -> Node:
        return self._left(self.joined, "+", "-")

    def joined(self) -> Node:
        return self._left(self.multiplied, "~")

    def multiplied(self) -> Node:
        return self._left(self.raised, "*", "/", "//", "%")

    def raised(self) -> Node:
        return self._left(self.signed, "**")

    def signed(self, filters: bool = True) -> Node:
        if self.take("-"):
            node = Node("negative", parts=(self.signed(False),))
        elif self.take("+"):
            node = self.signed(False)
        else:
            node = self.suffixed(self.primary())
        return self.filtered(node) if filters else node

    def primary(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind in ("int", "float", "str"):
            self.at += 1
            value = _unescaped(text) if kind == "str" else ast.literal_eval(text)
            while kind == "str" and self.tokens[self.at][0] == "str":
                value += _unescaped(self.tokens[self.at][1])
                self.at += 1
            return Node("literal", value)
        if kind == "name":
            self.at += 1
            constants = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return Node("literal", constants[text]) if text in constants else Node("name", text)
        if self.take("("):
            items = self._list(")")
            return items[0] if len(items) == 1 and self.tokens[self.at - 2][1] != "," else Node("tuple", parts=tuple(items))
        if self.take("["):
            return Node("list", parts=tuple(self._list("]")))
        if self.take("{"):
            keys, values = [], []
            while not self.take("}"):
                keys.append(self.expression())
                self.need(":")
                values.append(self.expression())
                if not self.peek("}"):
                    self.need(",")
            return Node("dict", tuple(keys), tuple(values))
        raise TemplateError(f"unexpected {text or 'end'!r} in {self.text!r}")

    def _list(self, close: str) -> list[Node]:
        out = []
        while not self.take(close):
            out.append(self.expression())
            if not self.peek(close):
                self.need(",")
        return out

    def suffixed(self, node: Node) -> Node:
        while True:
            if self.take("."):
                kind, text = self.tokens[self.at]
                self.at += 1
                if kind not in ("name", "int"):
                    raise TemplateError(f"unexpected {text!r} after '.' in {self.text!r}")
                node = Node("item", "." if kind == "name" else None, (node, Node("literal", text if kind == "name" else int(text))))
            elif self.take("["):
                first = None if self.peek(":") else self.expression()
                if self.take(":"):
                    last = None if self.peek("]", ":") else self.expression()
                    step = self.expression() if self.take(":") and not self.peek("]") else None
                    node = Node("slice", parts=(node, first, last, step))
                else:
                    node = Node("item", parts=(node, first))
                self.need("]")
            elif self.take("("):
                node = Node("call", parts=(node, *self._arguments()))
            else:
                return node

    def _arguments(self) -> list[Node]:
        out = []
        while not self.take(")"):
            kind, text = self.tokens[self.at]
            if kind == "name" and self.tokens[self.at + 1] == ("op", "="):
                self.at += 2
                out.append(Node("keyword", text, (self.expression(),)))
            else:
                out.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return out

    def filtered(self, node: Node) -> Node:
        while True:
            if self.take("|"):
                name = self.name()
                node = Node("filter", name, (node, *(self._arguments() if self.take("(") else ())))
            elif self.take("is"):
                negate = bool(self.take("not"))
                name, arguments = self.name(), ()
                if self.take("("):
                    arguments = tuple(self._arguments())
                elif self.tokens[self.at][0] in ("int", "float", "str") or self.peek("[") or (self.tokens[self.at][0] == "name" and not self.peek("and", "or", "else", "is", "if", "not", "in")):
                    arguments = (self.suffixed(self.primary()),)
                node = Node("test", name, (node, *arguments))
                node = Node("not", parts=(node,)) if negate else node
            else:
                return node


class _Blocks:
    def __init__(self, source: str):
        self.source, self.pieces, self.at = source, _pieces(source), 0

    def whole(self) -> tuple[Node, ...]:
        body, end = self.body(())
        return body

    def body(self, until: tuple[str, ...]) -> tuple[tuple[Node, ...], _Expression | None]:
        out: list[Node] = []
        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Node("text", text))
            elif kind == "out":
                out.append(Node("out", parts=(_Expression(text).whole(),)))
            else:
                e = _Expression(text)
                word = e.name()
                if word in until:
                    return tuple(out), _with_word(e, word)
                if word not in ("if", "for", "set", "with", "filter", "macro", "call"):
                    raise UnsupportedTemplate(f"no {word!r} block in {self.source!r}")
                out.append(getattr(self, f"_{word}")(e))
        if until:
            raise TemplateError(f"expected {' or '.join(until)} in {self.source!r}")
        return tuple(out), None

    def _if(self, e: _Expression) -> Node:
        branches, otherwise, condition = [], (), e.whole()
        while True:
            body, e = self.body(("elif", "else", "endif"))
            branches.append((condition, body))
            if e.word == "elif":
                condition = e.whole()
                continue
            if e.word == "else":
                otherwise, _ = self.body(("endif",))
            return Node("if", tuple(branches), otherwise)

    def _for(self, e: _Expression) -> Node:
        target = [e.name()]
        while e.take(","):
            target.append(e.name())
        e.need("in")
        over = e.either()
        if e.peek(","):
            rest = [over]
            while e.take(","):
                rest.append(e.either())
            over = Node("tuple", parts=tuple(rest))
        keep = e.expression() if e.take("if") else None
        again = bool(e.take("recursive"))
        e.done()
        body, end = self.body(("else", "endfor"))
        otherwise = self.body(("endfor",))[0] if end.word == "else" else ()
        return Node("for", (tuple(target), over, keep, again), (body, otherwise))

    def _set(self, e: _Expression) -> Node:
        names = [e.name()]
        if e.take("."):
            target = (names[0], e.name())
            e.need("=")
            return Node("set_attribute", target, (e.whole(),))
        while e.take(","):
            names.append(e.name())
        if e.take("="):
            return Node("set", tuple(names), (e.whole(),))
        if len(names) > 1:
            raise TemplateError(f"a block can't be set to {len(names)} names in {self.source!r}")
        filters = []
        while e.take("|"):
            filters.append((e.name(), tuple(e._arguments()) if e.take("(") else ()))
        e.done()
        body, _ = self.body(("endset",))
        return Node("set_block", names[0], (Node("filtered_block", tuple(filters), body),))

    def _with(self, e: _Expression) -> Node:
        names = []
        while e.tokens[e.at][0] != "end":
            name = e.name()
            e.need("=")
            names.append((name, e.expression()))
            e.take(",")
        body, _ = self.body(("endwith",))
        return Node("with", tuple(names), body)

    def _filter(self, e: _Expression) -> Node:
        node = Node("filtered_block")
        filters = []
        while True:
            filters.append((e.name(), tuple(e._arguments()) if e.take("(") else ()))
            if not e.take("|"):
                break
        e.done()
        body, _ = self.body(("endfilter",))
        return Node(node.kind, tuple(filters), body)

    def _parameters(self, e: _Expression) -> tuple:
        out = []
        while not e.take(")"):
            name = e.name()
            out.append((name, e.expression() if e.take("=") else None))
            if not e.peek(")"):
                e.need(",")
        return tuple(out)

    def _macro(self, e: _Expression) -> Node:
        name = e.name()
        e.need("(")
        parameters = self._parameters(e)
        e.done()
        body, _ = self.body(("endmacro",))
        return Node("macro", (name, parameters), body)

    def _call(self, e: _Expression) -> Node:
        parameters = self._parameters(e) if e.take("(") else ()
        call = e.whole()
        if call.kind != "call":
            raise TemplateError(f"a call block needs a call in {self.source!r}")
        body, _ = self.body(("endcall",))
        return Node("call_block", (call, parameters), body)


def _with_word(e: _Expression, word: str) -> _Expression:
    e.word = word
    return e


def parse(source: str) -> tuple[Node, ...]:
    return _Blocks(source).whole()


def single_variable(source: str) -> str | None:
    """The name, if the template is one output of one bare name and nothing else."""
    body = parse(source)
    if len(body) == 1 and body[0].kind == "out" and body[0].parts[0].kind == "name":
        return body[0].parts[0].value
    return None


def free_variables(source: str) -> set[str]:
    """The names a template reads and doesn't bind itself."""
    out: set[str] = set()

    def walk(x: Any, bound: frozenset[str]) -> frozenset[str]:
        if isinstance(x, Node):
            if x.kind == "name" and x.value not in bound:
                out.add(x.value)
            elif x.kind == "if":
                ends = []
                for condition, body in x.value:
                    walk(condition, bound)
                    ends.append(walk(body, bound))
                ends.append(walk(x.parts, bound))
                return bound | frozenset.intersection(*ends)  # set on every way through
            elif x.kind == "for":
                names, over, keep, _ = x.value
                walk(over, bound)
                inner = bound | set(names) | {"loop"}
                walk(keep, inner)
                walk(x.parts[0], inner)
                walk(x.parts[1], bound)
            elif x.kind == "set":
                walk(x.parts, bound)
                return bound | set(x.value)
            elif x.kind == "set_attribute":
                walk((Node("name", x.value[0]), *x.parts), bound)
            elif x.kind == "set_block":
                walk(x.parts, bound)
                return bound | {x.value}
            elif x.kind == "macro":
                inner = bound | {name for name, _ in x.value[1]} | {x.value[0], "caller", "varargs", "kwargs"}
                for _, e in x.value[1]:
                    walk(e, bound)
                walk(x.parts, inner)
                return bound | {x.value[0]}
            elif x.kind == "call_block":
                walk(x.value[0], bound)
                walk(x.parts, bound | {name for name, _ in x.value[1]})
            elif x.kind == "filtered_block":
                for _, arguments in x.value:
                    walk(arguments, bound)
                walk(x.parts, bound)
            elif x.kind == "with":
                inner = bound
                for name, e in x.value:
                    walk(e, bound)
                    inner = inner | {name}
                walk(x.parts, inner)
            else:
                walk(x.value if isinstance(x.value, tuple) else None, bound)
                walk(x.parts, bound)
        elif isinstance(x, tuple):
            for y in x:
                bound = walk(y, bound)
        return bound

    walk(parse(source), frozenset())
    return out - GLOBALS


#: Functions that every template knows.
GLOBALS = {"range", "dict", "namespace", "cycler", "joiner"}
#: Attribute names that mean methods of dictionaries in the template language.
_METHODS = {"items", "keys", "values", "get", "copy", "pop", "update"}


@dataclass
class Scope:
    names: dict[str, Value]
    source: str = field(default="")
    calls: tuple[tuple[str, int], ...] = ()  # macros under way, with the size of the types they were given
    state: dict[Any, Value] = field(default_factory=dict)  # what outlives a round of a loop; one for the whole template

    def child(self, **more: Value) -> Scope:
        return Scope(self.names | more, self.source, self.calls, self.state)


@dataclass(frozen=True)
class Listed(Value):
    """A list or tuple whose elements are known one by one, so each may have a type of its own."""

    elements: tuple[Value, ...] = ()
    is_tuple: bool = False


def listed(elements: Iterable[Value], is_tuple: bool = False) -> Value:
    """As an array too, if the elements have one type."""
    elements = tuple(elements)
    try:
        whole = V.array(list(elements))
    except PlanError:
        whole = Value(F.lit(None), T.ArrayType(T.NullType()))
    return Listed(whole.col, whole.type, True, elements, is_tuple)


@dataclass(frozen=True)
class Keyed(Value):
    """A dictionary of the template; its values keep what is known of them."""

    entries: tuple[tuple[str, Value], ...] = ()

    def field(self, name: str) -> Value:
        return dict(self.entries).get(name) or V.null()


def keyed(entries: dict[str, Value]) -> Value:
    whole = V.struct(entries)
    return Keyed(whole.col, whole.type, True, tuple(entries.items()))


@dataclass(frozen=True)
class Maybe(Value):
    """A value that is undefined in some rows, where its column is null."""

    there: Column | None = None


@dataclass(frozen=True)
class Macro(Value):
    name: str = ""
    parameters: tuple = ()
    body: tuple = ()
    scope: Scope | None = None


@dataclass(frozen=True)
class Stateful(Value):
    """A namespace, cycler or joiner: its state is in the scope under its key."""

    kind: str = ""
    key: int = 0
    elements: tuple[Value, ...] = ()


@dataclass(frozen=True)
class Loop(Value):
    """The ``loop`` of one round: numbers, the elements beside it, and what a recursive loop does with the next level."""

    key: int = 0
    beside: dict[str, Value] | None = None
    again: Callable[[Value], Column] | None = None


def undefined() -> Value:
    return Value(F.lit(None), T.NullType(), defined=False)


def depth_of(v: Value) -> int:
    """How deep the type of a value is nested."""

    def depth(t: T.DataType) -> int:
        if isinstance(t, T.ArrayType):
            return 1 + depth(t.elementType)
        if isinstance(t, T.MapType):
            return 1 + depth(t.valueType)
        if isinstance(t, T.StructType):
            return 1 + max((depth(f.dataType) for f in t.fields), default=0)
        return 1 + max(map(depth, t.options)) if isinstance(t, Mixed) else 0

    return depth(v.type) if v.defined else 0


def either_way(scope: Scope, condition: Column, yes: Callable[[], Any], no: Callable[[], Any]) -> tuple[Any, Any]:
    """What both sides of a branch give, each begun with the same names and state. What they leave behind is chosen by the condition."""
    tables = (scope.names, scope.state)
    before = [dict(t) for t in tables]
    a = yes()
    after = [dict(t) for t in tables]
    for t, was in zip(tables, before, strict=True):
        t.clear()
        t.update(was)
    b = no()
    for t, other in zip(tables, after, strict=True):
        for k in [*t, *(k for k in other if k not in t)]:
            if other.get(k) is not t.get(k):
                t[k] = _one_of(condition, other.get(k), t.get(k), scope)
    return a, b


def _one_of(condition: Column, a: Value | None, b: Value | None, scope: Scope) -> Value:
    x, y = (undefined() if v is None else v for v in (a, b))
    if not x.defined and not y.defined:
        return x
    if any(isinstance(v, (Macro, Stateful)) or v.defined and _apart(v) for v in (x, y)):
        raise UnsupportedTemplate(f"a name is set to different kinds of things, depending on a condition, in {scope.source!r}")
    kind = V.joined(x.type, y.type)
    col = F.when(condition, V.as_type(x, kind)).otherwise(V.as_type(y, kind))
    there = [F.lit(v.defined) if not isinstance(v, Maybe) else v.there for v in (x, y)]
    if x.defined and y.defined and not isinstance(x, Maybe) and not isinstance(y, Maybe):
        return Value(col, kind)
    return Maybe(col, kind, True, F.when(condition, there[0]).otherwise(there[1]))


def _apart(v: Value) -> bool:
    """Whether the elements of a list have no type in common, so that there is no array of them."""
    return isinstance(v, Listed) and bool(v.elements) and isinstance(v.type.elementType, T.NullType) and not all(x.is_null for x in v.elements)


def truth(v: Value) -> Column:
    t = v.type
    if isinstance(v, Listed):
        return F.lit(bool(v.elements))
    if isinstance(v, (Macro, Stateful, Loop)):
        return F.lit(True)
    if not v.defined or isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, Mixed):
        return F.coalesce(V.by_option(v, lambda x: _boolean(truth(x))).col, F.lit(False))
    if isinstance(t, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    if V.is_number(t):
        return F.coalesce(v.col != 0, F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def text_of(v: Value, scope: Scope) -> Column:
    if not v.defined:
        return F.lit("")
    if isinstance(v, (Macro, Stateful, Loop)):
        raise UnsupportedTemplate(f"no text for a function or an object in {scope.source!r}")
    text = represented(v) if isinstance(v, (Listed, Keyed)) else pytext.py_str(v)
    return F.when(v.there, text).otherwise("") if isinstance(v, Maybe) else text


def represented(v: Value) -> Column:
    """As inside a container. The elements of a list of the template are written by their own types."""
    if isinstance(v, Listed):
        parts = [x for i, e in enumerate(v.elements) for x in ([F.lit(", ")] if i else []) + [represented(e)]]
        opening, close = ("(", ",)" if len(v.elements) == 1 else ")") if v.is_tuple else ("[", "]")
        return F.concat(F.lit(opening), *parts, F.lit(close))
    if isinstance(v, Keyed):
        parts = [x for i, (n, e) in enumerate(v.entries) for x in (F.lit(f"{', ' if i else ''}{n!r}: "), represented(e))]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    return pytext.py_repr(v)


def compile_template(source: str, names: dict[str, Value]) -> Value:
    """The text of a template, or the variable itself if the template is just ``{{ variable }}``."""
    name = single_variable(source)
    if name is not None and name in names:
        return names[name]
    return render(source, names)


def render(source: str, names: dict[str, Value]) -> Value:
    """The text of a template, whatever it consists of."""
    return Value(_body(parse(source), Scope(dict(names), source=source)), T.StringType())


def _body(nodes: tuple[Node, ...], scope: Scope, own: bool = True) -> Column:
    """The text of nodes in sequence. ``own``: whether names set in them are theirs only."""
    parts: list[Column | str] = []
    scope = scope.child() if own else scope
    for node in nodes:
        if node.kind == "text":
            if parts and isinstance(parts[-1], str):
                parts[-1] += node.value
            else:
                parts.append(node.value)
        elif node.kind == "set":
            scope.names.update(_unpacked(node.value, evaluate(node.parts[0], scope), scope))
        elif node.kind == "set_attribute":
            of = scope.names.get(node.value[0])
            if not isinstance(of, Stateful) or of.kind != "namespace":
                raise TemplateError(f"{node.value[0]!r} isn't a namespace in {scope.source!r}")
            scope.state[of.key, node.value[1]] = evaluate(node.parts[0], scope)
        elif node.kind == "set_block":
            scope.names[node.value] = Value(_body(node.parts, scope), T.StringType())
        elif node.kind == "macro":
            scope.names[node.value[0]] = Macro(F.lit(None), T.NullType(), True, *node.value, node.parts, scope)
        else:
            parts.append(getattr(_Render, node.kind)(node, scope))
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return columns[0] if len(columns) == 1 else F.concat(*columns) if columns else F.lit("")


def known(node: Node, scope: Scope) -> bool | None:
    """Whether a condition holds, if the types tell: what is undefined there isn't compiled."""
    if node.kind == "not":
        inner = known(node.parts[0], scope)
        return None if inner is None else not inner
    if node.kind == "binary" and node.value in ("and", "or"):
        sides = [known(p, scope) for p in node.parts]
        stop = node.value == "or"
        return stop if stop in sides else None if None in sides else not stop
    if node.kind == "test" and node.value in ("defined", "undefined"):
        v = evaluate(node.parts[0], scope)
        return None if isinstance(v, Maybe) else v.defined == (node.value == "defined")
    if node.kind == "literal":
        return bool(node.value)
    if node.kind in ("name", "item", "undefined"):
        v = evaluate(node, scope)
        return False if not v.defined or v.is_null and not isinstance(v, (Macro, Stateful)) else None
    return None


class _Render:
    @staticmethod
    def out(node: Node, scope: Scope) -> Column:
        return text_of(evaluate(node.parts[0], scope), scope)

    @staticmethod
    def with_(node: Node, scope: Scope) -> Column:
        return _body(node.parts, scope.child(**{name: evaluate(e, scope) for name, e in node.value}))

    @staticmethod
    def if_(node: Node, scope: Scope) -> Column:
        return _branches(node.value, node.parts, scope)

    @staticmethod
    def filtered_block(node: Node, scope: Scope) -> Column:
        v = Value(_body(node.parts, scope), T.StringType())
        for name, arguments in node.value:
            v = _filtered(name, v, arguments, scope)
        return text_of(v, scope)

    @staticmethod
    def call_block(node: Node, scope: Scope) -> Column:
        call, parameters = node.value
        caller = Macro(F.lit(None), T.NullType(), True, "caller", parameters, node.parts, scope)
        return text_of(_called(call, scope, caller), scope)

    @staticmethod
    def for_(node: Node, scope: Scope) -> Column:
        return _looped(node, evaluate(node.value[1], scope), scope)


for _word in ("if", "for", "with"):
    setattr(_Render, _word, staticmethod(getattr(_Render, f"{_word}_")))


def _branches(branches: tuple, otherwise: tuple[Node, ...], scope: Scope) -> Column:
    """The first branch whose condition holds. Names set in a branch outlive it."""
    if not branches:
        return _body(otherwise, scope, own=False)
    (condition, body), *rest = branches
    told = known(condition, scope)
    if told is not None:
        return _body(body, scope, own=False) if told else _branches(tuple(rest), otherwise, scope)
    holds = truth(evaluate(condition, scope))
    yes, no = either_way(scope, holds, lambda: _body(body, scope, own=False), lambda: _branches(tuple(rest), otherwise, scope))
    return F.when(holds, yes).otherwise(no)


def _looped(node: Node, v: Value, scope: Scope, level: int = 0) -> Column:
    names, _, keep, recursive = node.value
    if isinstance(v, (Listed, Keyed)) or isinstance(v.type, T.StructType):
        elements = v.elements if isinstance(v, Listed) else tuple(V.literal(n) for n in v.type.names)
        return _unrolled(node, elements, v, scope, level)
    if isinstance(v.type, T.MapType):  # as of a dictionary: its keys
        v = Value(F.map_keys(v.col), T.ArrayType(v.type.keyType))
    if isinstance(v.type, Mixed) and any(isinstance(t, T.ArrayType) for t in v.type.options):
        v = V.option(v, next(t for t in v.type.options if isinstance(t, T.ArrayType)))
    if isinstance(v.type, T.StringType):
        v = _array(v, scope)
    if not isinstance(v.type, T.ArrayType):
        if v.defined and not v.is_null:
            raise UnsupportedTemplate(f"no loop over a {v.type.simpleString()} in {scope.source!r}")
        return _body(node.parts[1], scope)
    element, key = v.type.elementType, id(node)

    def kept(x: Column) -> Column:
        inner, was = scope.child(**_unpacked(names, Value(x, element), scope)), dict(scope.state)
        holds = truth(evaluate(keep, inner))
        if any(was.get(k) is not x for k, x in scope.state.items()):
            raise UnsupportedTemplate(f"the condition of a loop changes something in {scope.source!r}")
        return holds

    items = v.col if keep is None else F.filter(v.col, kept)
    n = F.size(items)

    def one(x: Column, i: Column) -> Column:
        beside = lambda at, there: Maybe(F.get(items, at), element, True, there)
        loop = _loop(i, n, level, key, {"previtem": beside(i - 1, i > 0), "nextitem": beside(i + 1, i < n - 1)}, _again(node, v, scope, level))
        return _body(node.parts[0], scope.child(**_unpacked(names, Value(x, element), scope), loop=loop))

    def rounds() -> Column:
        before = {k: x for k, x in scope.state.items() if k[0] != ("loop", key)}  # loop.changed() begins anew
        _reset(scope, before)
        one(F.lit(None).cast(element), F.lit(0))
        changed = [k for k, x in scope.state.items() if before.get(k) is not x]
        _reset(scope, before)
        return _folded(items, one, changed, scope) if changed else F.array_join(F.transform(items, one), "")

    some = F.coalesce(n, F.lit(0)) > 0
    yes, no = either_way(scope, some, rounds, lambda: _body(node.parts[1], scope))
    return F.when(some, yes).otherwise(no)


def _reset(scope: Scope, state: dict[Any, Value]) -> None:
    scope.state.clear()
    scope.state.update(state)


def _folded(items: Column, one: Callable[[Column, Column], Column], changed: list, scope: Scope) -> Column:
    """A loop whose rounds leave something behind, as an aggregation over its items. (The text is copied in each round.)"""
    before = dict(scope.state)
    begun = {k: before.get(k) or V.null() for k in changed}
    kinds = {k: v.type for k, v in begun.items()}

    def after(acc: Callable[[int], Column], x: Column, i: Column) -> tuple[Column, list[Value]]:
        scope.state.update({k: Value(acc(j), kinds[k]) for j, k in enumerate(changed)})
        text = one(x, i)
        left = [scope.state[k] for k in changed]
        _reset(scope, before)
        if any(isinstance(v, (Macro, Stateful)) or _apart(v) for v in left):
            raise UnsupportedTemplate(f"a loop can't keep such a value from round to round in {scope.source!r}")
        return text, left

    for _ in range(4):  # until the types that a round leaves behind are those it began with
        _, left = after(lambda j: F.lit(None).cast(kinds[changed[j]]), F.get(items, F.lit(0)), F.lit(0))
        wider = {k: V.joined(kinds[k], v.type) for k, v in zip(changed, left, strict=True)}
        if wider == kinds:
            break
        kinds = wider
    else:
        raise UnsupportedTemplate(f"the types of what a loop keeps don't settle in {scope.source!r}")
    kinds = {k: T.StringType() if isinstance(t, T.NullType) else t for k, t in kinds.items()}

    def step(acc: Column, x: Column) -> Column:
        text, left = after(lambda j: acc.getField(f"s{j}"), x, acc.getField("i"))
        kept = [V.as_type(v, kinds[k]).alias(f"s{j}") for j, (k, v) in enumerate(zip(changed, left, strict=True))]
        return F.struct((acc.getField("i") + 1).alias("i"), F.concat(acc.getField("text"), text).alias("text"), *kept)

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("text"), *[V.as_type(begun[k], kinds[k]).alias(f"s{j}") for j, k in enumerate(changed)])
    done = F.aggregate(items, start, step)
    scope.state.update({k: Value(done.getField(f"s{j}"), kinds[k]) for j, k in enumerate(changed) if not isinstance(k[0], tuple)})
    return done.getField("text")


def _again(node: Node, v: Value, scope: Scope, level: int) -> Callable[[Value], Column] | None:
    if not node.value[3]:
        return None

    def run(inner: Value) -> Column:
        if depth_of(inner) >= depth_of(v):
            raise UnsupportedTemplate(f"a recursive loop has to go down in the type of what it goes over in {scope.source!r}")
        return _looped(node, inner, scope, level + 1)

    return run


def _loop(i: Column, n: Column, level: int, key: int, beside: dict[str, Value] | None, again: Callable[[Value], Column] | None) -> Value:
    number = lambda c: Value(c, T.IntegerType())
    flag = lambda c: Value(c, T.BooleanType())
    numbers = V.struct({
        "index": number(i + 1), "index0": number(i), "revindex": number(n - i), "revindex0": number(n - i - 1),
        "first": flag(i == 0), "last": flag(i == n - 1), "length": number(n), "depth": number(F.lit(level + 1)), "depth0": number(F.lit(level)),
    })
    return Loop(numbers.col, numbers.type, True, key, beside, again)


def _changed(loop: Loop, values: list[Value], scope: Scope) -> Value:
    """Whether the values differ from those of the last call in this loop."""
    mark = ("loop", loop.key)
    now = V.struct({f"v{i}": v if not v.is_null else Value(v.col.cast("string"), T.StringType()) for i, v in enumerate(values)})
    seen, last = scope.state.get((mark, "seen")), scope.state.get((mark, "last"))
    same = F.lit(False)
    if last is not None and not last.is_null:
        kind = V.unify(last.type, now.type)
        if kind is None or V.is_mixed(kind):
            raise UnsupportedTemplate(f"loop.changed() of values of different types in {scope.source!r}")
        same = F.coalesce(seen.col.cast("boolean"), F.lit(False)) & V.as_type(last, kind).eqNullSafe(V.as_type(now, kind))
    scope.state[mark, "seen"], scope.state[mark, "last"] = _boolean(F.lit(True)), now
    return _boolean(~same)


def _unpacked(names: tuple[str, ...], v: Value, scope: Scope) -> dict[str, Value]:
    """The names of a loop (or a pair of items) with their values."""
    if len(names) == 1:
        return {names[0]: v}
    if isinstance(v, Listed):
        parts = v.elements
    elif isinstance(v.type, T.StructType) and len(v.type.names) == len(names):
        parts = [v.field(n) for n in v.type.names]
    elif isinstance(v.type, T.ArrayType):
        parts = [v.item(i) for i in range(len(names))]
    else:
        raise UnsupportedTemplate(f"a {v.type.simpleString()} can't be unpacked into {len(names)} names in {scope.source!r}")
    if len(parts) != len(names):
        raise TemplateError(f"{len(parts)} values for {len(names)} names in {scope.source!r}")
    return dict(zip(names, parts, strict=True))


def _unrolled(node: Node, elements: tuple[Value, ...], v: Value, scope: Scope, level: int) -> Column:
    """A loop over elements that are known one by one."""
    names, _, keep, _ = node.value
    if not elements:
        return _body(node.parts[1], scope)
    bound = [_unpacked(names, e, scope) for e in elements]
    holds = [F.lit(1) if keep is None else truth(evaluate(keep, scope.child(**b))).cast("int") for b in bound]
    n, before, parts = sum(holds[1:], holds[0]), F.lit(0), []
    _reset(scope, {k: x for k, x in scope.state.items() if k[0] != ("loop", id(node))})

    def rounds() -> list[Column]:
        nonlocal before
        for i, (b, k) in enumerate(zip(bound, holds, strict=True)):
            at = lambda j: elements[j] if 0 <= j < len(elements) else undefined()
            beside = {"previtem": at(i - 1), "nextitem": at(i + 1)} if keep is None else None
            loop = _loop(before, n, level, id(node), beside, _again(node, v, scope, level))
            body = lambda b=b, loop=loop: _body(node.parts[0], scope.child(**b, loop=loop))
            if keep is None:
                parts.append(body())
            else:
                parts.append(F.when(k == 1, either_way(scope, k == 1, body, lambda: None)[0]).otherwise(""))
            before = before + k
        return parts

    if keep is None:
        return F.concat(*rounds())
    yes, no = either_way(scope, n > 0, rounds, lambda: _body(node.parts[1], scope))
    return F.when(n > 0, F.concat(*yes)).otherwise(no)


def _called(node: Node, scope: Scope, caller: Macro | None = None) -> Value:
    """A macro's text, with the arguments of a call bound to its parameters."""
    target = node.parts[0]
    macro = scope.names.get(target.value) if target.kind == "name" else None
    if not isinstance(macro, Macro):
        raise UnsupportedTemplate(f"no macro {target.value!r} in {scope.source!r}")
    given = [evaluate(p, scope) for p in node.parts[1:] if p.kind != "keyword"]
    by_name = {p.value: evaluate(p.parts[0], scope) for p in node.parts[1:] if p.kind == "keyword"}
    if len(given) > len(macro.parameters) or set(by_name) - {n for n, _ in macro.parameters}:
        raise TemplateError(f"macro {macro.name!r} takes {len(macro.parameters)} arguments in {scope.source!r}")
    size = sum(map(depth_of, [*given, *by_name.values()]))
    last = next((n for name, n in reversed(scope.calls) if name == macro.name), None) if macro.name != "caller" else None
    if last is not None and size >= last:  # it ends only where each call gets less of the type than the one before
        raise UnsupportedTemplate(f"macro {macro.name!r} calls itself, but not with a part of what it was given, in {scope.source!r}")
    inner = macro.scope.child()
    inner.calls = (*scope.calls, (macro.name, size))
    for i, (name, default) in enumerate(macro.parameters):
        inner.names[name] = given[i] if i < len(given) else by_name[name] if name in by_name else undefined() if default is None else evaluate(default, inner)
    if caller is not None:
        inner.names["caller"] = caller
    return Value(_body(macro.body, inner), T.StringType())


def evaluate(node: Node, scope: Scope) -> Value:
    return getattr(_Eval, node.kind)(node, scope)


def _boolean(c: Column) -> Value:
    return Value(c, T.BooleanType())


class _Eval:
    @staticmethod
    def name(node: Node, scope: Scope) -> Value:
        return scope.names.get(node.value) or undefined()

    @staticmethod
    def undefined(node: Node, scope: Scope) -> Value:
        return undefined()

    @staticmethod
    def literal(node: Node, scope: Scope) -> Value:
        return V.literal(node.value)

    @staticmethod
    def list(node: Node, scope: Scope) -> Value:
        return listed(evaluate(p, scope) for p in node.parts)

    @staticmethod
    def tuple(node: Node, scope: Scope) -> Value:
        return listed((evaluate(p, scope) for p in node.parts), is_tuple=True)

    @staticmethod
    def dict(node: Node, scope: Scope) -> Value:
        if any(k.kind != "literal" for k in node.value):  # a map, whose values need one type; of equal keys the last value counts, at the place of the first
            keys, values = V.array([evaluate(k, scope) for k in node.value]), V.array([evaluate(p, scope) for p in node.parts])
            pairs = F.arrays_zip(keys.col.alias("k"), values.col.alias("v"))
            first = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys.col, F.lit(1), i), e["k"]))
            value = lambda e: F.element_at(F.filter(pairs, lambda p: p["k"] == e["k"]), -1)["v"]
            return Value(F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"].alias("k"), value(e).alias("v")))), T.MapType(keys.type.elementType, values.type.elementType))
        return keyed({str(k.value): evaluate(p, scope) for k, p in zip(node.value, node.parts, strict=True)})

    @staticmethod
    def item(node: Node, scope: Scope) -> Value:
        base = evaluate(node.parts[0], scope)
        if isinstance(base, Listed) and isinstance(i := _integer(node.parts[1]), int):
            return base.elements[i] if -len(base.elements) <= i < len(base.elements) else undefined()
        if isinstance(base, (Loop, Stateful)):
            return _attribute_of(base, node.parts[1], scope)
        if isinstance(base, Maybe):  # an error where it isn't there
            absent = F.raise_error(F.lit("an attribute of an undefined value")).cast(base.type)
            base = Value(F.when(base.there, base.col).otherwise(absent), base.type)
        if not base.defined:
            raise TemplateError(f"an attribute of an undefined value in {scope.source!r}")
        key = node.parts[1]
        if key.kind == "literal" and isinstance(key.value, str):
            if isinstance(base.type, T.StructType):
                if key.value in base.type.names:
                    if node.value == "." and key.value in _METHODS:
                        warnings.warn(f"{key.value!r} is read as a field, not a method, in {scope.source!r}", stacklevel=2)
                    return base.field(key.value)
                return undefined()
            return base.field(key.value) if isinstance(base.type, (T.MapType, Mixed)) else undefined()
        if key.kind == "negative" or (key.kind == "literal" and isinstance(key.value, int)):
            i = -key.parts[0].value if key.kind == "negative" else key.value
            if isinstance(base.type, T.StringType):
                at = F.lit(i + 1) if i >= 0 else F.length(base.col) + F.lit(i + 1)
                return Value(F.substring(base.col, at, F.lit(1)), T.StringType())
            return base.item(i) if isinstance(base.type, (T.ArrayType, Mixed)) else undefined()
        i = evaluate(key, scope)
        if isinstance(base.type, T.ArrayType) and V.is_integer(i.type):
            return Value(F.get(base.col, F.when(i.col < 0, F.size(base.col) + i.col).otherwise(i.col).cast("int")), base.type.elementType)
        if isinstance(base.type, T.MapType):
            return Value(F.try_element_at(base.col, V.as_type(i, base.type.keyType)), base.type.valueType)
        if isinstance(base.type, T.StructType) and isinstance(i.type, T.StringType) and base.type.names:
            kind = V.all_joined(f.dataType for f in base.type.fields)
            out = F.when(F.lit(False), F.lit(None).cast(kind))
            for n in base.type.names:
                out = out.when(i.col == n, V.as_type(base.field(n), kind))
            return Value(out, kind)
        raise UnsupportedTemplate(f"a computed key in {scope.source!r}")

    @staticmethod
    def slice(node: Node, scope: Scope) -> Value:
        base = evaluate(node.parts[0], scope)
        first, last = (None if p is None else evaluate(p, scope).col for p in node.parts[1:3])
        step = _constant(node.parts[3], 1, scope)
        if step is None or not isinstance(step, int) or not step:
            raise TemplateError(f"a slice step of {step!r} in {scope.source!r}")
        if isinstance(base, Listed) and all(p is None or isinstance(_integer(p), int) for p in node.parts[1:3]):
            ends = (None if p is None else _integer(p) for p in node.parts[1:3])
            return listed(base.elements[slice(*ends, step)], base.is_tuple)
        if not isinstance(base.type, (T.StringType, T.ArrayType)):
            raise UnsupportedTemplate(f"a slice of a {base.type.simpleString()} in {scope.source!r}")
        n = F.length(base.col) if isinstance(base.type, T.StringType) else F.size(base.col)
        low, high = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
        bound = lambda c, default: default if c is None else F.least(F.greatest(F.when(c < 0, n + c).otherwise(c), low), high).cast("int")
        a, b = bound(first, low if step > 0 else high), bound(last, high if step > 0 else low)
        if step == 1:
            size = F.greatest(b - a, F.lit(0))
            return Value(F.substring(base.col, a + 1, size) if isinstance(base.type, T.StringType) else F.slice(base.col, a + 1, size), base.type)
        places = _stepped(a, b, step)
        picked = F.transform(places, lambda i: F.get(_array(base, scope).col, i))
        return Value(F.array_join(picked, "") if isinstance(base.type, T.StringType) else picked, base.type)

    @staticmethod
    def call(node: Node, scope: Scope) -> Value:
        name = node.parts[0]
        if name.kind == "name" and isinstance(scope.names.get(name.value), Macro):
            return _called(node, scope)
        if name.kind == "name" and name.value in ("namespace", "cycler", "joiner") and name.value not in scope.names:
            return _stateful(node, scope)
        if name.kind == "name" and name.value == "dict":
            if any(p.kind != "keyword" for p in node.parts[1:]):
                raise UnsupportedTemplate(f"dict() takes names only in {scope.source!r}")
            return keyed({p.value: evaluate(p.parts[0], scope) for p in node.parts[1:]})
        arguments = [evaluate(p, scope) for p in node.parts[1:]]
        if name.kind == "name" and name.value == "range" and len(arguments) in (1, 2, 3):
            first, last = (F.lit(0), arguments[0].col) if len(arguments) == 1 else (arguments[0].col, arguments[1].col)
            if len(arguments) == 3:
                return Value(_stepped(first, last, _constant(node.parts[3], 1, scope)), T.ArrayType(T.IntegerType()))
            return Value(V.sequence(first.cast("int"), last.cast("int") - 1), T.ArrayType(T.IntegerType()))
        target = scope.names.get(name.value) if name.kind == "name" else None
        if isinstance(target, Loop) and target.again and len(arguments) == 1:
            return Value(target.again(arguments[0]), T.StringType())
        if isinstance(target, Stateful) and target.kind == "joiner" and not arguments:
            used = scope.state[target.key, "used"]
            scope.state[target.key, "used"] = _boolean(F.lit(True))
            return Value(F.when(used.col, text_of(target.elements[0], scope)).otherwise(""), T.StringType())
        if name.kind == "item" and name.value == ".":
            method, base = name.parts[1].value, evaluate(name.parts[0], scope)
            if isinstance(base, Loop) and method == "cycle" and arguments:
                return _turn(tuple(arguments), base.field("index0").col % len(arguments), scope)
            if isinstance(base, Loop) and method == "changed":
                return _changed(base, arguments, scope)
            if isinstance(base, Stateful) and base.kind == "cycler" and method in ("next", "reset") and not arguments:
                at = scope.state[base.key, "at"].col
                scope.state[base.key, "at"] = Value((at + 1) % len(base.elements) if method == "next" else F.lit(0), T.IntegerType())
                return _turn(base.elements, at, scope) if method == "next" else V.null()
            if isinstance(base.type, T.StringType):
                return _text_method(base, method, node.parts[1:], scope)
            if method in _METHODS and isinstance(base.type, (T.StructType, T.MapType)):
                return _method(base, method, node.parts[1:], scope)
        raise UnsupportedTemplate(f"no call of {name.value or name.kind!r} in {scope.source!r}")

    @staticmethod
    def negative(node: Node, scope: Scope) -> Value:
        v = evaluate(node.parts[0], scope)
        return Value(-v.col, v.type)

    @staticmethod
    def inline_if(node: Node, scope: Scope) -> Value:
        told = known(node.parts[0], scope)
        if told is not None:
            return evaluate(node.parts[1 if told else 2], scope)
        holds = truth(evaluate(node.parts[0], scope))
        a, b = either_way(scope, holds, lambda: evaluate(node.parts[1], scope), lambda: evaluate(node.parts[2], scope))
        kind = V.unify(a.type, b.type)
        plain = not any(isinstance(v, Maybe) or not v.defined or _apart(v) for v in (a, b))
        if kind is None or not plain:  # an undefined side prints nothing
            return Value(F.when(holds, text_of(a, scope)).otherwise(text_of(b, scope)), T.StringType())
        return Value(F.when(holds, V.as_type(a, kind)).otherwise(V.as_type(b, kind)), kind)

    @staticmethod
    def not_(node: Node, scope: Scope) -> Value:
        return _boolean(~truth(evaluate(node.parts[0], scope)))

    @staticmethod
    def binary(node: Node, scope: Scope) -> Value:
        op, a = node.value, evaluate(node.parts[0], scope)
        if op in ("and", "or"):  # the right side counts only where the left one doesn't decide
            b, _ = either_way(scope, truth(a) if op == "and" else ~truth(a), lambda: evaluate(node.parts[1], scope), lambda: None)
        else:
            b = evaluate(node.parts[1], scope)
        if op == "~":
            return Value(F.concat(text_of(a, scope), text_of(b, scope)), T.StringType())
        if op in ("and", "or"):
            kind = V.unify(a.type, b.type) if a.defined and b.defined else None
            if kind is None:
                both = (truth(a) & truth(b)) if op == "and" else (truth(a) | truth(b))
                return _boolean(both)
            x, y = V.as_type(a, kind), V.as_type(b, kind)
            return Value(F.when(truth(a), y if op == "and" else x).otherwise(x if op == "and" else y), kind)
        if op in ("in", "not in"):
            found = _contains(b, a, scope)
            return _boolean(~found if op == "not in" else found)
        if op in ("==", "!="):
            same = equal(a, b) if a.defined and b.defined else F.lit(a.defined == b.defined)
            same = same & v.there if isinstance(v := a if isinstance(a, Maybe) else b, Maybe) else same
            return _boolean(same if op == "==" else ~same)
        numbers = V.is_number(a.type) and V.is_number(b.type)
        texts = isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType)
        if op in ("<", "<=", ">", ">=", "+", "-", "*", "/", "//", "%", "**") and a.defined and b.defined and (a.is_null or b.is_null):
            kind = T.BooleanType() if "<" in op or ">" in op else b.type if a.is_null else a.type
            return Value(F.raise_error(F.lit(f"no {op!r} of None in {scope.source!r}")).cast(kind), kind)
        if op in ("<", "<=", ">", ">=") and (numbers or texts):
            return _boolean({"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op])
        if op == "+" and texts:
            return Value(F.concat(a.col, b.col), T.StringType())
        if op == "+" and isinstance(a.type, T.ArrayType) and a.type == b.type:
            return Value(F.concat(a.col, b.col), a.type)
        if numbers:
            whole = V.is_integer(a.type) and V.is_integer(b.type)
            if op in ("+", "-", "*"):
                kind = T.LongType() if whole else T.DoubleType()
                x, y = a.col.cast(kind), b.col.cast(kind)
                return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)
            if op == "/":
                return Value(a.col.cast("double") / b.col.cast("double"), T.DoubleType())
            if op in ("//", "%") and not whole:
                x, y = a.col.cast("double"), b.col.cast("double")
                rest = x % y  # has the sign of x, Python's that of y
                rest = F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
                return Value(F.bround((x - rest) / y, 0) if op == "//" else rest, T.DoubleType())
            if op in ("//", "%") and whole:  # Python rounds down
                down = F.floor(a.col.cast("decimal(38,0)") / b.col.cast("decimal(38,0)")).cast("long")
                return Value(down if op == "//" else a.col - down * b.col, T.LongType())
            if op == "**":
                power = F.pow(a.col, b.col)
                return Value(power.cast("long"), T.LongType()) if whole else Value(power, T.DoubleType())
        raise UnsupportedTemplate(f"no {op!r} of {a.type.simpleString()} and {b.type.simpleString()} in {scope.source!r}")

    @staticmethod
    def filter(node: Node, scope: Scope) -> Value:
        return _filtered(node.value, evaluate(node.parts[0], scope), node.parts[1:], scope)

    @staticmethod
    def test(node: Node, scope: Scope) -> Value:
        v = evaluate(node.parts[0], scope)
        others = [evaluate(p, scope) for p in node.parts[1:]]
        return _boolean(_test(node.value, v, others, scope))


setattr(_Eval, "not", staticmethod(_Eval.not_))


def _filtered(name: str, v: Value, given: tuple[Node, ...], scope: Scope) -> Value:
    arguments = [p for p in given if p.kind != "keyword"]
    keywords = {p.value: p.parts[0] for p in given if p.kind == "keyword"}
    if name not in FILTERS:
        raise UnsupportedTemplate(f"no filter {name!r} in {scope.source!r}")
    f = FILTERS[name]
    try:
        inspect.signature(f).bind(v, scope, *arguments, **keywords)
    except TypeError as e:
        raise TemplateError(f"filter {name!r}: {e} in {scope.source!r}") from None
    return f(v, scope, *arguments, **keywords)


def _stepped(first: Column, last: Column, step: int) -> Column:
    if not step:
        raise TemplateError("range() takes no step of 0")
    first, last = first.cast("int"), (last.cast("int") - (1 if step > 0 else -1))
    some = (last >= first) if step > 0 else (last <= first)
    return F.when(some, F.sequence(F.when(some, first), F.when(some, last), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _integer(node: Node) -> int | None:
    """A constant whole number of the template."""
    if node.kind == "negative":
        inner = _integer(node.parts[0])
        return None if inner is None else -inner
    return node.value if node.kind == "literal" and isinstance(node.value, int) else None


def _attribute_of(base: Loop | Stateful, key: Node, scope: Scope) -> Value:
    name = key.value if key.kind == "literal" else None
    if isinstance(base, Loop):
        if name in base.type.names:
            return base.field(name)
        if name in ("previtem", "nextitem") and base.beside is not None:
            return base.beside[name]
        raise UnsupportedTemplate(f"no {name!r} of a loop here in {scope.source!r}")
    if base.kind == "namespace":
        return scope.state.get((base.key, name)) or undefined()
    if base.kind == "cycler" and name == "current":
        return _turn(base.elements, scope.state[base.key, "at"].col, scope)
    raise UnsupportedTemplate(f"no {name!r} of a {base.kind} in {scope.source!r}")


def _turn(elements: tuple[Value, ...], at: Column, scope: Scope) -> Value:
    kind = V.all_joined(e.type for e in elements)
    return Value(F.get(F.array(*[V.as_type(e, kind) for e in elements]), at), kind)


def _stateful(node: Node, scope: Scope) -> Value:
    """A namespace, cycler or joiner, its state begun."""
    kind, key = node.parts[0].value, id(node)
    given = [evaluate(p, scope) for p in node.parts[1:] if p.kind != "keyword"]
    by_name = {p.value: evaluate(p.parts[0], scope) for p in node.parts[1:] if p.kind == "keyword"}
    if kind == "namespace" and all(isinstance(v, Keyed) for v in given):
        for name, v in [*(e for of in given for e in of.entries), *by_name.items()]:
            scope.state[key, name] = v
    elif kind == "cycler" and given and not by_name:
        scope.state[key, "at"] = Value(F.lit(0), T.IntegerType())
    elif kind == "joiner" and len(given) + len(by_name) < 2 and set(by_name) <= {"sep"}:
        scope.state[key, "used"] = _boolean(F.lit(False))
        given = [*given, *by_name.values(), V.literal(", ")][:1]
    else:
        raise TemplateError(f"{kind}() takes other arguments in {scope.source!r}")
    return Stateful(F.lit(None), T.NullType(), True, kind, key, tuple(given))


def _text_method(base: Value, method: str, given: tuple[Node, ...], scope: Scope) -> Value:
    """What a method of Python's ``str`` gives, for those that have a form in columns."""
    filters = {"upper": "upper", "lower": "lower", "capitalize": "capitalize", "replace": "replace"}
    if method in filters and (method == "replace") == (len(given) == 2):
        return _filtered(filters[method], base, given, scope)
    one = evaluate(given[0], scope) if given else None
    text, of = base.col, (lambda c: Value(c, T.StringType()))
    if method in ("strip", "lstrip", "rstrip") and len(given) < 2:
        left, right = method != "rstrip", method != "lstrip"
        if one is None:
            return of(F.regexp_replace(text, "|".join([f"^{_SPACE}+"] * left + [rf"{_SPACE}+\z"] * right), ""))
        trim = F.btrim if left and right else F.ltrim if left else F.rtrim
        return of(trim(text, one.col))
    if method == "split" and len(given) < 3:
        most = _constant(given[1] if len(given) == 2 else None, -1, scope)
        if one is None or one.is_null:
            if most >= 0:
                raise UnsupportedTemplate(f"split() by white space with a limit in {scope.source!r}")
            return Value(F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != ""), T.ArrayType(T.StringType()))
        mark = F.concat(F.lit("\\Q"), F.replace(one.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return Value(F.split(text, mark, most + 1 if most >= 0 else -1), T.ArrayType(T.StringType()))
    if method == "splitlines" and not given:
        return Value(wrapping.lines(text), T.ArrayType(T.StringType()))
    if method in ("startswith", "endswith") and one is not None and len(given) == 1:
        marks = one.elements if isinstance(one, Listed) else (one,)
        found = [text.startswith(m.col) if method == "startswith" else text.endswith(m.col) for m in marks]
        return _boolean(F.greatest(*found) if len(found) > 1 else found[0])
    if method in ("removeprefix", "removesuffix") and one is not None:
        n, m = F.length(text), F.length(one.col)
        if method == "removeprefix":
            return of(F.when(text.startswith(one.col), F.substring(text, m + 1, n)).otherwise(text))
        return of(F.when(text.endswith(one.col), F.substring(text, F.lit(1), n - m)).otherwise(text))
    if method == "count" and one is not None and len(given) == 1:
        gone = F.length(text) - F.length(F.replace(text, one.col, F.lit("")))
        return Value(F.when(F.length(one.col) == 0, F.length(text) + 1).otherwise(F.floor(gone / F.greatest(F.length(one.col), F.lit(1)))).cast("long"), T.LongType())
    if method == "find" and one is not None and len(given) == 1:
        return Value((F.call_function("locate", one.col, text) - 1).cast("long"), T.LongType())
    if method == "join" and one is not None and isinstance(one.type, T.ArrayType) and isinstance(one.type.elementType, T.StringType):
        return of(F.call_function("array_join", one.col, text))
    if method in ("isdigit", "isalpha", "isalnum", "isspace") and not given:
        kind = {"isdigit": r"\p{Nd}", "isalpha": r"\p{L}", "isalnum": r"[\p{L}\p{Nd}]", "isspace": _SPACE}[method]
        return _boolean(text.rlike(f"^{kind}+\\z"))
    if method == "zfill" and one is not None:
        sign = F.when(text.rlike("^[+-]"), F.substring(text, 1, 1)).otherwise("")
        gap = F.greatest(one.col.cast("int") - F.length(text), F.lit(0))
        return of(F.concat(sign, F.repeat(F.lit("0"), gap), F.substring(text, F.length(sign) + 1, F.length(text))))
    raise UnsupportedTemplate(f"no call of {method!r} of a text in {scope.source!r}")


def _method(base: Value, method: str, given: tuple[Node, ...], scope: Scope) -> Value:
    """What a dictionary's method gives for a struct or a map."""
    if method == "items" and not given:
        return _items(base, scope)
    if method in ("keys", "values") and not given:
        if isinstance(base.type, T.StructType):
            return listed([V.literal(n) if method == "keys" else base.field(n) for n in base.type.names])
        return Value(F.map_keys(base.col), T.ArrayType(base.type.keyType)) if method == "keys" else Value(F.map_values(base.col), T.ArrayType(base.type.valueType))
    if method == "get" and len(given) in (1, 2):
        key, other = _constant(given[0], "", scope), evaluate(given[1], scope) if len(given) == 2 else V.null()
        if isinstance(base.type, T.StructType):
            return base.field(key) if key in base.type.names else other
        found, kind = base.field(key), V.unify(base.type.valueType, other.type)
        if kind is not None:
            return Value(F.when(F.map_contains_key(base.col, F.lit(key)), V.as_type(found, kind)).otherwise(V.as_type(other, kind)), kind)
    raise UnsupportedTemplate(f"no call of {method!r} in {scope.source!r}")


def _contains(whole: Value, part: Value, scope: Scope) -> Column:
    if isinstance(whole, Listed):
        found = [equal(e, part) for e in whole.elements]
        return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)) if found else F.lit(False)
    if isinstance(whole.type, T.StringType):
        return F.coalesce(whole.col.contains(text_of(part, scope)), F.lit(False))
    if isinstance(whole.type, T.ArrayType):
        kind = V.unify(whole.type.elementType, part.type)
        return F.lit(False) if kind is None else F.coalesce(F.exists(whole.col, lambda x: x.cast(kind).eqNullSafe(V.as_type(part, kind))), F.lit(False))
    if isinstance(whole.type, T.StructType):
        return F.array_contains(F.array(*map(F.lit, whole.type.names)), part.col)
    if isinstance(whole.type, T.MapType):
        return F.map_contains_key(whole.col, part.col)
    raise UnsupportedTemplate(f"no 'in' for a {whole.type.simpleString()} in {scope.source!r}")


def _test(name: str, v: Value, others: list[Value], scope: Scope) -> Column:
    t = v.type
    static = {
        "string": isinstance(t, T.StringType), "number": V.is_number(t), "integer": V.is_integer(t), "float": isinstance(t, (T.DoubleType, T.FloatType)),
        "boolean": isinstance(t, T.BooleanType), "mapping": isinstance(t, (T.StructType, T.MapType)), "callable": False,
        "sequence": isinstance(t, (T.ArrayType, T.StringType, T.StructType, T.MapType)), "iterable": isinstance(t, (T.ArrayType, T.StringType, T.StructType, T.MapType)),
    }
    if name in ("defined", "undefined"):
        there = v.there if isinstance(v, Maybe) else F.lit(v.defined)
        return there if name == "defined" else ~there
    if isinstance(v, Maybe) and name == "none":
        return v.there & v.col.isNull()
    if name == "escaped":  # texts here are never marked as safe
        return F.lit(False)
    if name in ("filter", "test") and isinstance(t, T.StringType):
        known = sorted(FILTERS) if name == "filter" else TESTS
        return F.coalesce(v.col.isin(*known), F.lit(False))
    if name == "none":
        return v.col.isNull() if v.defined else F.lit(False)
    if name in static:
        return F.lit(static[name]) & v.col.isNotNull()
    if name in ("even", "odd"):
        return F.pmod(v.col, F.lit(2)) == (0 if name == "even" else 1)
    if name == "divisibleby":
        return F.pmod(v.col, others[0].col) == 0
    if name in ("true", "false"):
        return F.coalesce(v.col == (name == "true"), F.lit(False)) if isinstance(t, T.BooleanType) else F.lit(False)
    if name in ("upper", "lower"):  # as str.isupper: some letter, and none of the other case
        other = F.lower(v.col) if name == "upper" else F.upper(v.col)
        same = F.upper(v.col) if name == "upper" else F.lower(v.col)
        return (v.col == same) & (v.col != other)
    ops = {"eq": "==", "equalto": "==", "ne": "!=", "lt": "<", "lessthan": "<", "le": "<=", "gt": ">", "greaterthan": ">", "ge": ">=", "in": "in", "sameas": "=="}
    if name in ops:
        inner = scope.child(**{"_a": v, "_b": others[0]})
        return evaluate(Node("binary", ops[name], (Node("name", "_a"), Node("name", "_b"))), inner).col
    raise UnsupportedTemplate(f"no test {name!r} in {scope.source!r}")


#: The names that ``is test`` knows.
TESTS = [
    "boolean", "callable", "defined", "divisibleby", "eq", "equalto", "escaped", "even", "false", "filter", "float", "ge", "greaterthan", "gt", "in", "integer", "iterable", "le",
    "lessthan", "lower", "lt", "mapping", "ne", "none", "number", "odd", "sameas", "sequence", "string", "test", "true", "undefined", "upper",
]


def _constant(node: Node | None, default: Any, scope: Scope) -> Any:
    if node is None:
        return default
    if node.kind == "negative" and node.parts[0].kind == "literal":
        return -node.parts[0].value
    if node.kind != "literal":
        raise UnsupportedTemplate(f"a filter's argument must be constant in {scope.source!r}")
    return node.value


def _text_filter(f):
    def run(v: Value, scope: Scope) -> Value:
        return Value(f(text_of(v, scope)), T.StringType())

    return run


def _array(v: Value, scope: Scope) -> Value:
    if isinstance(v.type, T.ArrayType):
        return v
    if isinstance(v.type, T.StringType):
        return Value(F.filter(F.split(v.col, ""), lambda c: c != ""), T.ArrayType(T.StringType()))
    raise UnsupportedTemplate(f"a list is needed, not a {v.type.simpleString()}, in {scope.source!r}")


def _length(v: Value, scope: Scope) -> Value:
    if isinstance(v, Listed):
        return V.literal(len(v.elements))
    if isinstance(v.type, T.StringType):
        return Value(F.length(v.col).cast("long"), T.LongType())
    if isinstance(v.type, T.StructType):
        return Value(F.lit(len(v.type.names)).cast("long"), T.LongType())
    return Value(F.size(v.col).cast("long"), T.LongType())


def _default(v: Value, scope: Scope, other: Node | None = None, boolean: Node | None = None, default_value: Node | None = None) -> Value:
    other = evaluate(other or default_value or Node("literal", ""), scope)
    if not v.defined:
        return other
    if not _constant(boolean, False, scope):
        return _one_of(v.there, Value(v.col, v.type), other, scope) if isinstance(v, Maybe) else v
    kind = V.unify(v.type, other.type)
    if kind is None:
        return Value(F.when(truth(v), text_of(v, scope)).otherwise(text_of(other, scope)), T.StringType())
    return Value(F.when(truth(v), V.as_type(v, kind)).otherwise(V.as_type(other, kind)), kind)


def _joined(v: Value, scope: Scope, glue: Node | None = None, attribute: Node | None = None) -> Value:
    if isinstance(v, Listed) and attribute is None:  # each by its own type
        return Value(F.concat_ws(_constant(glue, "", scope), *[text_of(e, scope) for e in v.elements]), T.StringType())
    v = _array(v, scope)
    if attribute is not None:
        v = _mapped(v, scope, attribute=attribute)
    texts = F.transform(v.col, lambda x: text_of(Value(x, v.type.elementType), scope))
    return Value(F.array_join(texts, _constant(glue, "", scope)), T.StringType())


def _mapped(v: Value, scope: Scope, name: Node | None = None, *arguments: Node, attribute: Node | None = None) -> Value:
    v = _array(v, scope)
    element, inner = v.type.elementType, scope

    def one(x: Column) -> Value:
        item = Value(x, element)
        if attribute is not None:
            for key in str(_constant(attribute, "", scope)).split("."):
                item = item.field(key)
            return item
        f = _constant(name, "", scope)
        if f not in FILTERS:
            raise UnsupportedTemplate(f"no filter {f!r} in {scope.source!r}")
        return FILTERS[f](item, inner, *arguments)

    kind = one(F.lit(None).cast(element)).type
    return Value(F.transform(v.col, lambda x: one(x).col), T.ArrayType(kind))


def _picked(keep: bool, by_attribute: bool):
    def run(v: Value, scope: Scope, *arguments: Node) -> Value:
        v = _array(v, scope)
        rest = list(arguments)
        path = str(_constant(rest.pop(0), "", scope)).split(".") if by_attribute else []
        name = _constant(rest.pop(0), None, scope) if rest else None

        def ok(x: Column) -> Column:
            item = Value(x, v.type.elementType)
            for key in path:
                item = item.field(key)
            found = truth(item) if name is None else F.coalesce(_test(name, item, [evaluate(r, scope) for r in rest], scope), F.lit(False))
            return found if keep else ~found

        return Value(F.filter(v.col, ok), v.type)

    return run


def _ordered(v: Value, scope: Scope, reverse: Node | None = None, case_sensitive: Node | None = None, attribute: Node | None = None) -> Value:
    v = _array(v, scope)
    down = bool(_constant(reverse, False, scope))
    fold = not _constant(case_sensitive, False, scope)
    path = str(_constant(attribute, "", scope)).split(".") if attribute is not None else []

    def key(x: Column) -> Column:
        item = Value(x, v.type.elementType)
        for k in path:
            item = item.field(k)
        return F.lower(item.col) if fold and isinstance(item.type, T.StringType) else item.col

    sign = -1 if down else 1  # a reversed sort keeps the order of ties
    places = F.array_sort(F.transform(v.col, lambda x, i: F.struct(key(x).alias("k"), (i * sign).alias("i"))))
    places = F.reverse(places) if down else places
    return Value(F.transform(places, lambda s: F.get(v.col, s["i"] * sign)), v.type)


def _unique(v: Value, scope: Scope, case_sensitive: Node | None = None) -> Value:
    v = _array(v, scope)
    if not isinstance(v.type.elementType, T.StringType) or _constant(case_sensitive, False, scope):
        return Value(F.array_distinct(v.col), v.type)
    folded = F.transform(v.col, lambda x: F.lower(x))
    return Value(F.filter(v.col, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1), v.type)


def _extreme(last: bool):
    def run(v: Value, scope: Scope, case_sensitive: Node | None = None, attribute: Node | None = None) -> Value:
        ordered = _ordered(v, scope, Node("literal", last), case_sensitive, attribute)
        return Value(F.get(ordered.col, F.lit(0)), ordered.type.elementType)

    return run


def _sum(v: Value, scope: Scope, attribute: Node | None = None, start: Node | None = None) -> Value:
    v = _mapped(v, scope, attribute=attribute) if attribute is not None and attribute != Node("literal", None) else _array(v, scope)
    first = evaluate(start, scope) if start is not None else V.literal(0)
    whole = V.is_integer(first.type) and (V.is_integer(v.type.elementType) or isinstance(v.type.elementType, (T.BooleanType, T.NullType)))
    if not (V.is_number(first.type) and isinstance(v.type.elementType, (T.NumericType, T.BooleanType, T.NullType))):
        raise UnsupportedTemplate(f"a sum of {v.type.elementType.simpleString()} from {first.type.simpleString()} in {scope.source!r}")
    kind = T.LongType() if whole else T.DoubleType()
    return Value(F.aggregate(v.col, first.col.cast(kind), lambda a, x: a + x.cast(kind)), kind)


def _number(kind: T.DataType):
    def run(v: Value, scope: Scope, default: Node | None = None) -> Value:
        other = F.lit(_constant(default, 0, scope)).cast(kind)
        found = v.col.try_cast("double") if isinstance(v.type, T.StringType) else v.col.cast("double")
        return Value(F.coalesce(F.when(found < 0, F.ceil(found)).otherwise(F.floor(found)).cast("long") if isinstance(kind, T.LongType) else found, other), kind)

    return run


def _tojson(v: Value, scope: Scope, indent: Node | None = None) -> Value:
    n = _constant(indent, None, scope)
    if not v.defined or isinstance(v, (Macro, Stateful, Loop)):
        raise TemplateError(f"tojson of something undefined in {scope.source!r}")
    raw = _json(v, n if n is None or isinstance(n, str) else " " * n, 0)
    for mark, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("'", "\\u0027")):
        raw = F.replace(raw, F.lit(mark), F.lit(code))
    return Value(raw, T.StringType())


def _json(v: Value, indent: str | None, depth: int) -> Column:
    """As :func:`pytext.py_json`; lists and dictionaries of the template are written by their own types."""
    if not isinstance(v, (Listed, Keyed)):
        return pytext.py_json(v, indent, depth)
    inner = [_json(e, indent, depth + 1) for e in v.elements] if isinstance(v, Listed) else [F.concat(pytext.json_text(F.lit(n)), F.lit(": "), _json(e, indent, depth + 1)) for n, e in sorted(v.entries, key=lambda e: e[0])]
    opening, close = "[]" if isinstance(v, Listed) else "{}"
    return pytext.bracketed(opening, close, F.array(*inner), indent, depth) if inner else F.lit(opening + close)


def _truncate(v: Value, scope: Scope, length: Node | None = None, killwords: Node | None = None, end: Node | None = None, leeway: Node | None = None) -> Value:
    n, kill, tail, more = (_constant(a, d, scope) for a, d in ((length, 255), (killwords, False), (end, "..."), (leeway, 5)))
    text = text_of(v, scope)
    short = F.substring(text, 1, n - len(tail))
    if not kill:  # back to the last space, if there is one
        cut = F.length(short) - F.instr(F.reverse(short), " ")
        short = F.when(F.instr(short, " ") > 0, F.substring(short, F.lit(1), cut)).otherwise(short)
    return Value(F.when(F.length(text) <= n + more, text).otherwise(F.concat(short, F.lit(tail))), T.StringType())


def _escape(text: Column) -> Column:
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def _title(text: Column) -> Column:
    """Each run of characters between separators starts with a capital."""
    words = F.regexp_extract_all(text, F.lit(r"([-\s({\[<]+|[^-\s({\[<]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def _items(v: Value, scope: Scope) -> Value:
    """Pairs of key and value; those of a struct may differ in type."""
    if isinstance(v.type, T.MapType):
        entries = V.Pair([T.StructField("key", v.type.keyType), T.StructField("value", v.type.valueType)])
        return Value(F.map_entries(v.col), T.ArrayType(entries))
    if not isinstance(v.type, T.StructType):
        raise UnsupportedTemplate(f"items of a {v.type.simpleString()} in {scope.source!r}")
    return listed(listed([V.literal(n), v.field(n)], is_tuple=True) for n in v.type.names)


def _dictsort(v: Value, scope: Scope, case_sensitive: Node | None = None, by: Node | None = None, reverse: Node | None = None) -> Value:
    fold, down = not _constant(case_sensitive, False, scope), bool(_constant(reverse, False, scope))
    part = _constant(by, "key", scope)
    if part not in ("key", "value"):
        raise TemplateError(f"dictsort by {part!r} in {scope.source!r}")
    items = _items(v, scope)
    if isinstance(items, Listed) and part == "key":
        names = sorted(v.type.names, key=lambda n: n.lower() if fold else n, reverse=down)
        return listed(listed([V.literal(n), v.field(n)], is_tuple=True) for n in names)
    if isinstance(items, Listed):  # which comes first is known in each row only, so the values need one type
        entries = [V.struct({"key": V.literal(n), "value": x}) for n, x in ((n, v.field(n)) for n in v.type.names)]
        try:
            whole = V.array(entries)
            items = Value(whole.col, T.ArrayType(V.Pair(whole.type.elementType.fields)))
        except PlanError:
            raise UnsupportedTemplate(f"dictsort by values of different types in {scope.source!r}") from None
    kind = items.type.elementType[part].dataType
    key = lambda e: F.lower(e[part]) if fold and isinstance(kind, T.StringType) else e[part]
    sign = -1 if down else 1  # a reversed sort keeps the order of ties
    ordered = F.array_sort(F.transform(items.col, lambda e, i: F.struct(key(e).alias("k"), (i * sign).alias("i"), e.alias("e"))))
    ordered = F.transform(F.reverse(ordered) if down else ordered, lambda x: x["e"])
    return Value(ordered, items.type)


def _grouped(v: Value, scope: Scope, attribute: Node, default: Node | None = None, case_sensitive: Node | None = None) -> Value:
    """Pairs of a value of the attribute and the elements that have it, by value."""
    v, path = _array(v, scope), str(_constant(attribute, "", scope)).split(".")
    fold, other = not _constant(case_sensitive, False, scope), None if default is None else evaluate(default, scope)

    def found(x: Column) -> Value:
        item = Value(x, v.type.elementType)
        for k in path:
            item = item.field(k)
        return item if other is None else Value(F.coalesce(item.col, other.col), item.type)

    kind = found(F.lit(None).cast(v.type.elementType)).type
    key = lambda x: F.lower(found(x).col) if fold and isinstance(kind, T.StringType) else found(x).col
    keys = F.array_sort(F.array_distinct(F.transform(v.col, key)))
    own = lambda k: F.filter(v.col, lambda x: key(x).eqNullSafe(k))
    pair = V.Pair([T.StructField("grouper", kind), T.StructField("list", v.type)])
    return Value(F.transform(keys, lambda k: F.struct(found(F.get(own(k), F.lit(0))).col.alias("grouper"), own(k).alias("list"))), T.ArrayType(pair))


def _indented(v: Value, scope: Scope, width: Node | None = None, first: Node | None = None, blank: Node | None = None) -> Value:
    n = _constant(width, 4, scope)
    space = n if isinstance(n, str) else " " * n
    gap = "\\n" if _constant(blank, False, scope) else "\\n(?=[^\\n])"
    text = F.regexp_replace(text_of(v, scope), gap, re.sub(r"([\\$])", r"\\\1", f"\n{space}"))
    return Value(F.concat(F.lit(space), text) if _constant(first, False, scope) else text, T.StringType())


def _centred(v: Value, scope: Scope, width: Node | None = None) -> Value:
    n, text = int(_constant(width, 80, scope)), text_of(v, scope)
    gap = F.greatest(F.lit(n) - F.length(text), F.lit(0))
    left = F.floor(gap / 2).cast("int") + gap.bitwiseAND(F.lit(n)).bitwiseAND(F.lit(1))
    return Value(F.concat(F.repeat(F.lit(" "), left), text, F.repeat(F.lit(" "), gap - left)), T.StringType())


def _filesize(v: Value, scope: Scope, binary: Node | None = None) -> Value:
    base = 1024 if _constant(binary, False, scope) else 1000
    size = v.col.cast("double")
    names = [f"{c}{'iB' if base == 1024 else 'B'}" for c in (("K" if base == 1024 else "k"), *"MGTPEZY")]
    out = F.format_string(f"%.1f {names[-1]}", size / float(base ** len(names)))
    for i, name in reversed(list(enumerate(names[:-1]))):
        out = F.when(size < float(base ** (i + 2)), F.format_string(f"%.1f {name}", size / float(base ** (i + 1)))).otherwise(out)
    out = F.when(size < base, F.format_string("%d Bytes", size.cast("long"))).otherwise(out)
    return Value(F.when(size == 1, "1 Byte").otherwise(out), T.StringType())


def _attributes(v: Value, scope: Scope, autospace: Node | None = None) -> Value:
    if not isinstance(v.type, T.StructType):
        raise UnsupportedTemplate(f"xmlattr of a {v.type.simpleString()} in {scope.source!r}")
    some = [v.field(n) for n in v.type.names]
    each = [F.when(x.col.isNotNull(), F.concat(F.lit(f'{n}="'), _escape(text_of(x, scope)), F.lit('"'))) for n, x in zip(v.type.names, some, strict=True) if not x.is_null]
    text = F.array_join(F.array(*each), " ") if each else F.lit("")
    return Value(F.when(text != "", F.concat(F.lit(" "), text)).otherwise("") if _constant(autospace, True, scope) else text, T.StringType())


def _attribute(v: Value, scope: Scope, name: Node) -> Value:
    key = str(_constant(name, "", scope))
    return v.field(key) if isinstance(v.type, T.StructType) and key in v.type.names else undefined()


def _filled(parts: Column, v: Value, scope: Scope, fill: Node | None, gaps) -> Value:
    """Arrays of elements of ``v``, each with as many fillers as it has gaps."""
    kind = T.ArrayType(v.type)
    if fill is None or (fill.kind == "literal" and fill.value is None):
        return Value(parts, kind)
    other = V.as_type(evaluate(fill, scope), v.type.elementType)
    return Value(F.transform(parts, lambda p, i: F.concat(p, F.array_repeat(other, gaps(p, i)))), kind)


def _batch(v: Value, scope: Scope, linecount: Node, fill_with: Node | None = None) -> Value:
    v, n = _array(v, scope), int(_constant(linecount, 1, scope))
    starts = F.filter(F.transform(v.col, lambda x, i: i), lambda i: i % n == 0)
    return _filled(F.transform(starts, lambda i: F.slice(v.col, i + 1, F.lit(n))), v, scope, fill_with, lambda p, i: F.lit(n) - F.size(p))


def _slice(v: Value, scope: Scope, slices: Node, fill_with: Node | None = None) -> Value:
    v, n = _array(v, scope), int(_constant(slices, 1, scope))
    each, more = F.floor(F.size(v.col) / n).cast("int"), F.size(v.col) % n
    part = lambda i: F.slice(v.col, i * each + F.least(i, more) + 1, each + (i < more).cast("int"))
    return _filled(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), part), v, scope, fill_with, lambda p, i: (i >= more).cast("int"))


def _replaced(v: Value, scope: Scope, old: Node, new: Node) -> Value:
    return Value(F.replace(text_of(v, scope), evaluate(old, scope).col, evaluate(new, scope).col), T.StringType())


def _round(v: Value, scope: Scope, precision: Node | None = None, method: Node | None = None) -> Value:
    n, how = _constant(precision, 0, scope), _constant(method, "common", scope)
    if how not in ("common", "ceil", "floor"):
        raise TemplateError(f"round by {how!r} in {scope.source!r}")
    if how == "common" and V.is_integer(v.type):  # as Python's round, which gives a whole number for one
        return Value(v.col.cast("long") if n >= 0 else F.bround(v.col.cast("long"), n).cast("long"), T.LongType())
    if how == "common":
        return Value(F.bround(v.col.cast("double"), n), T.DoubleType())
    scaled = v.col.cast("double") * F.lit(10.0**n)
    return Value((F.ceil(scaled) if how == "ceil" else F.floor(scaled)).cast("double") / F.lit(10.0**n), T.DoubleType())


def _any_of(v: Value, scope: Scope) -> Value:
    """An element at random, another one each time the column is worked out."""
    v = _array(v, scope)
    return Value(F.get(v.col, F.floor(F.rand() * F.size(v.col)).cast("int")), v.type.elementType)


def _wrapped(v: Value, scope: Scope, width: Node | None = None, break_long_words: Node | None = None, wrapstring: Node | None = None, break_on_hyphens: Node | None = None) -> Value:
    n, long, mark, hyphens = (_constant(a, d, scope) for a, d in ((width, 79), (break_long_words, True), (wrapstring, None), (break_on_hyphens, True)))
    if not isinstance(n, int) or n < 1:
        raise TemplateError(f"wordwrap to a width of {n!r} in {scope.source!r}")
    return Value(wrapping.wordwrap(text_of(v, scope), n, bool(long), "\n" if mark is None else mark, bool(hyphens)), T.StringType())


def _linked(
    v: Value, scope: Scope, trim_url_limit: Node | None = None, nofollow: Node | None = None, target: Node | None = None, rel: Node | None = None, extra_schemes: Node | None = None,
) -> Value:
    limit, no, aim, rels = (_constant(a, d, scope) for a, d in ((trim_url_limit, None), (nofollow, False), (target, None), (rel, None)))
    schemes = [] if extra_schemes is None else [_constant(p, "", scope) for p in extra_schemes.parts]
    words = sorted({*(rels or "").split(), "noopener", *(["nofollow"] if no else [])})
    return Value(wrapping.urlize(_escape(text_of(v, scope)), limit, " ".join(words), aim, schemes), T.StringType())


def _format(v: Value, scope: Scope, *arguments: Node) -> Value:
    return Value(F.call_function("format_string", v.col, *[evaluate(a, scope).col for a in arguments]), T.StringType())


#: White space in the sense of Unicode, alone and at either end.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ENDS = rf"^{_SPACE}+|{_SPACE}+\z"


def _at(v: Value, i: int, scope: Scope) -> Value:
    if isinstance(v, Listed):
        return v.elements[i] if v.elements else undefined()
    return _array(v, scope).item(i)


def _replaces(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


FILTERS = {
    "upper": _text_filter(F.upper), "lower": _text_filter(F.lower), "capitalize": _text_filter(lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))),
    "title": _text_filter(_title), "string": _text_filter(lambda t: t), "escape": _text_filter(_escape), "e": _text_filter(_escape), "safe": _text_filter(lambda t: t),
    "trim": lambda v, s, chars=None: Value(F.regexp_replace(text_of(v, s), _ENDS, "") if chars is None else F.btrim(text_of(v, s), F.lit(_constant(chars, "", s))), T.StringType()),
    "striptags": _text_filter(lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<!--[\s\S]*?-->|<[^>]*>", ""), r"\s+", " "))),
    "urlencode": _text_filter(lambda t: _replaces(F.url_encode(t), {"+": "%20", "%2F": "/", "*": "%2A", "%7E": "~"})),
    "wordcount": lambda v, s: Value(F.regexp_count(text_of(v, s), F.lit(r"(?U)\w+")).cast("long"), T.LongType()),
    "replace": _replaced, "length": _length, "count": _length, "default": _default, "d": _default, "join": _joined, "map": _mapped, "tojson": _tojson,
    "reverse": lambda v, s: Value(F.reverse(v.col), v.type),
    "first": lambda v, s: _at(v, 0, s), "last": lambda v, s: _at(v, -1, s),
    "abs": lambda v, s: Value(F.abs(v.col), v.type), "round": _round, "int": _number(T.LongType()), "float": _number(T.DoubleType()),
    "list": _array, "sort": _ordered, "unique": _unique, "min": _extreme(False), "max": _extreme(True), "sum": _sum, "format": _format, "truncate": _truncate,
    "select": _picked(True, False), "reject": _picked(False, False), "selectattr": _picked(True, True), "rejectattr": _picked(False, True), "items": _items,
    "batch": _batch, "slice": _slice, "dictsort": _dictsort, "groupby": _grouped, "indent": _indented, "center": _centred, "filesizeformat": _filesize,
    "forceescape": _text_filter(_escape), "xmlattr": _attributes, "attr": _attribute, "wordwrap": _wrapped, "urlize": _linked, "random": _any_of,
}
