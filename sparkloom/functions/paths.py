"""Path expressions (JMESPath), parsed on the driver and compiled to Columns.

An expression is parsed to a small tree. A chain such as ``a[*].b[0]`` is kept
as a list of steps; a projecting step applies the steps after it, up to the
next flatten, to each element, and drops nulls. Types are those of the source
schema, so anything that can't work is an error before any job runs.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import values as V
from sparkloom.functions.values import Mixed, PlanError, Value


class PathError(PlanError):
    """A path that can't be parsed, or has no meaning for the source's types."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+)|(?P<number>-?\d+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<quoted>"(?:[^"\\]|\\.)*")
    |(?P<raw>'(?:[^'\\]|\\.)*')|(?P<json>`(?:[^`\\]|\\.)*`)|(?P<op>\|\||&&|==|!=|<=|>=|\[\?|\[\]|[.\[\]{}()*,:|&!<>@?])""",
    re.VERBOSE | re.DOTALL,
)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PathError(f"unexpected {text[at]!r} at {at} in {text!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self, *wanted: str) -> bool:
        kind, text = self.tokens[self.at]
        return kind == "op" and text in wanted

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise PathError(f"expected {wanted!r} before {self.tokens[self.at][1]!r} in {self.text!r}")

    def whole(self) -> Node:
        node = self.pipe()
        if self.tokens[self.at][0] != "end":
            raise PathError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return node

    def _left(self, deeper, *ops: str) -> Node:
        node = deeper()
        while op := self.take(*ops):
            node = Node(op, parts=(node, deeper()))
        return node

    def pipe(self) -> Node:
        return self._left(self.either, "|")

    def either(self) -> Node:
        return self._left(self.both, "||")

    def both(self) -> Node:
        return self._left(self.compared, "&&")

    def compared(self) -> Node:
        node = self.chain()
        op = self.take("==", "!=", "<=", ">=", "<", ">")
        return Node(op, parts=(node, self.chain())) if op else node

    def chain(self) -> Node:
        """A primary and its steps. ``!`` takes the primary and index brackets only."""
        if self.take("!"):
            nots = 1
            while self.take("!"):
                nots += 1
            inner = self.steps(self.primary(), brackets_only=True)
            for _ in range(nots):
                inner = Node("!", parts=(inner,))
            return self.steps(inner)
        if self.peek("[", "[?", "[]", "*") and not self._list_ahead():
            return self.steps(Node("@"))
        return self.steps(self.primary())

    def _list_ahead(self) -> bool:
        """Whether an opening bracket starts a multi-select list and not an index, slice or wildcard."""
        if not self.peek("["):
            return False
        kind, text = self.tokens[self.at + 1]
        return not (kind == "number" or text == ":" or (text == "*" and self.tokens[self.at + 2][1] == "]"))

    def primary(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind in ("name", "quoted"):
            self.at += 1
            if kind == "name" and self.take("("):
                return Node("call", text, tuple(self._list(")", self.argument)))
            return Node("field", json.loads(text) if kind == "quoted" else text)
        if kind == "raw":
            self.at += 1
            return Node("literal", text[1:-1].replace("\\'", "'"))
        if kind == "json":
            self.at += 1
            inner = text[1:-1].replace("\\`", "`").strip()
            try:
                return Node("literal", json.loads(inner))
            except ValueError:
                return Node("literal", inner)  # the old form without quotes
        if self.take("@"):
            return Node("@")
        if self.take("("):
            node = self.pipe()
            self.need(")")
            return node
        if self.peek("[", "{"):
            return self.multi()
        raise PathError(f"unexpected {text or 'end'!r} in {self.text!r}")

    def argument(self) -> Node:
        return Node("&", parts=(self.pipe(),)) if self.take("&") else self.pipe()

    def _list(self, close: str, item) -> list:
        out = []
        if not self.take(close):
            out.append(item())
            while self.take(","):
                out.append(item())
            self.need(close)
        return out

    def multi(self) -> Node:
        if self.take("["):
            return Node("list", parts=tuple(self._list("]", self.pipe)))
        self.need("{")
        pairs = self._list("}", self.pair)
        if not pairs:
            raise PathError(f"an empty multi-select in {self.text!r}")
        return Node("hash", tuple(k for k, _ in pairs), tuple(v for _, v in pairs))

    def pair(self) -> tuple[str, Node]:
        kind, text = self.tokens[self.at]
        if kind not in ("name", "quoted"):
            raise PathError(f"unexpected {text!r} in {self.text!r}")
        self.at += 1
        self.need(":")
        return json.loads(text) if kind == "quoted" else text, self.pipe()

    def steps(self, first: Node, brackets_only: bool = False) -> Node:
        steps: list[Node] = []
        while True:
            if self.peek("["):
                self.at += 1
                steps.append(self._bracket())
            elif brackets_only:
                break
            elif self.take("[]"):
                steps.append(Node("flatten"))
            elif self.take("[?"):
                steps.append(Node("filter", parts=(self.pipe(),)))
                self.need("]")
            elif self.take("."):
                steps.append(Node("values") if self.take("*") else self.multi() if self.peek("[", "{") else self.primary_step())
            elif self.peek("*") and first.kind == "@" and not steps:
                self.at += 1
                steps.append(Node("values"))
            else:
                break
        return Node("chain", parts=(first, *steps)) if steps else first

    def primary_step(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind not in ("name", "quoted"):
            raise PathError(f"unexpected {text or 'end'!r} after '.' in {self.text!r}")
        return self.primary()

    def _bracket(self) -> Node:
        if self.take("*"):
            self.need("]")
            return Node("each")
        parts: list[int | None] = [None]
        while not self.take("]"):
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "number":
                parts[-1] = int(text)
            elif text == ":" and len(parts) < 3:
                parts.append(None)
            else:
                raise PathError(f"unexpected {text or 'end'!r} in brackets of {self.text!r}")
        if len(parts) == 1:
            return Node("index", parts[0])
        if len(parts) == 3 and parts[2] == 0:
            raise PathError(f"a slice step of 0 in {self.text!r}")
        return Node("slice", (*parts, None)[:3])


def parse(text: str) -> Node:
    return _Parser(text).whole()


def root_fields(text: str) -> set[str] | None:
    """The fields of the row that a path reads; None if it may read any."""
    found: set[str] = set()

    def walk(node: Node) -> bool:
        if node.kind == "field":
            found.add(node.value)
            return True
        if node.kind == "@":
            return False
        if node.kind in ("chain", "|"):  # what follows goes on from there
            return walk(node.parts[0])
        return node.kind in ("literal", "&") or all(walk(p) for p in node.parts)

    return found if walk(parse(text)) else None


PROJECTING = ("each", "values", "filter", "flatten", "slice")


def truthy(v: Value) -> Column:
    """False for null, false and empty strings, arrays and objects; 0 is true."""
    t = v.type
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.VariantType):
        return F.coalesce(V.by_option(v, lambda x: Value(truthy(x), T.BooleanType())).col, F.lit(False))
    if isinstance(t, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def equal(a: Value, b: Value) -> Column:
    """Whether two values are the same; those of types that don't unify only if both are null."""
    if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
        mixed, other = (a, b) if isinstance(a.type, T.VariantType) else (b, a)
        found = V.by_option(mixed, lambda x: Value(equal(x, other), T.BooleanType())).col
        return F.when(V.present(mixed), F.coalesce(found, F.lit(False))).otherwise(~V.present(other))
    kind = V.unify(a.type, b.type)
    if kind is None:
        whole = isinstance(a.type, type(b.type)) and (V.is_mixed(a.type) or V.is_mixed(b.type))
        if not whole:
            return a.col.isNull() & b.col.isNull()
        kind = V.joined(a.type, b.type)
    x, y = V.as_type(a, kind), V.as_type(b, kind)
    if V.is_mixed(kind):  # variants have no order and no equality of their own
        x, y = F.to_json(F.to_variant_object(x)), F.to_json(F.to_variant_object(y))
    return x.eqNullSafe(y)


def compile_path(text: str, root: Value) -> Value:
    """The value of a path in ``root``. Unknown top-level names are errors."""
    return _Compiler(text).run(parse(text), root, top=True)


class _Compiler:
    def __init__(self, text: str):
        self.text = text

    def fail(self, why: str) -> PathError:
        return PathError(f"{why} in {self.text!r}")

    def run(self, node: Node, here: Value, top: bool = False) -> Value:
        return getattr(self, f"_{_METHODS.get(node.kind, node.kind)}")(node, here, top)

    def _here(self, node: Node, here: Value, top: bool) -> Value:
        return here

    def _field(self, node: Node, here: Value, top: bool) -> Value:
        if top and isinstance(here.type, T.StructType) and node.value not in here.type.names:
            raise self.fail(f"unknown field {node.value!r}")
        return here.field(node.value)

    def _literal(self, node: Node, here: Value, top: bool) -> Value:
        return V.literal(node.value, mixed=True)

    def _chain(self, node: Node, here: Value, top: bool) -> Value:
        return self.follow(self.run(node.parts[0], here, top), node.parts[1:])

    def follow(self, v: Value, steps: tuple[Node, ...]) -> Value:
        for i, step in enumerate(steps):
            if step.kind in PROJECTING:
                rest = steps[i + 1 :]
                end = next((k for k, s in enumerate(rest) if s.kind == "flatten"), len(rest))
                return self.follow(self.project(self.elements(v, step), rest[:end]), rest[end:])
            v = self._list(step, v, False) if step.kind == "list" else self.run(step, v)
        return v

    def elements(self, v: Value, step: Node) -> Value:
        """The array that a projecting step goes over."""
        if isinstance(v.type, T.VariantType):
            return V.by_option(v, lambda x: self.elements(x, step))
        if step.kind == "values":
            return self._values_of(v)
        if not isinstance(v.type, T.ArrayType):
            return V.null()
        if step.kind == "flatten":
            if isinstance(v.type.elementType, Mixed):
                return self._flattened(v)
            if not isinstance(v.type.elementType, T.ArrayType):
                return v
            return Value(F.flatten(F.filter(v.col, lambda x: x.isNotNull())), v.type.elementType)
        if step.kind == "filter":
            return Value(F.filter(v.col, lambda x: truthy(self.run(step.parts[0], Value(x, v.type.elementType)))), v.type)
        if step.kind == "slice":
            return Value(_slice(v.col, *step.value), v.type)
        return v

    @staticmethod
    def _flattened(v: Value) -> Value:
        """Of mixed elements only the arrays are opened."""
        inner = v.type.elementType
        arrays = [t for t in inner.options if isinstance(t, T.ArrayType)]
        if not arrays:
            return v
        kind = V.all_joined([*(t for t in inner.options if t not in arrays), arrays[0].elementType])

        def opened(x: Column) -> Column:
            item = Value(x, inner)
            own = F.array(V.as_type(V.by_option(item, lambda y: V.null() if isinstance(y.type, T.ArrayType) else y), kind))
            within = V.as_type(V.option(item, arrays[0]), T.ArrayType(kind))
            return F.when(V.is_option(item, arrays[0]), within).otherwise(own)

        return Value(F.flatten(F.transform(F.filter(v.col, lambda x: V.present(Value(x, inner))), opened)), T.ArrayType(kind))

    def _values_of(self, v: Value) -> Value:
        if isinstance(v.type, T.MapType):
            return Value(F.map_values(v.col), T.ArrayType(v.type.valueType))
        if isinstance(v.type, T.StructType):
            found = V.array([v.field(n) for n in v.type.names], mixed=True)
            return Value(F.when(v.col.isNotNull(), found.col), found.type)
        return V.null()

    def project(self, v: Value, steps: tuple[Node, ...]) -> Value:
        if not isinstance(v.type, T.ArrayType):
            return V.null()
        element = self.follow(Value(F.lit(None).cast(v.type.elementType), v.type.elementType), steps).type
        mapped = F.transform(v.col, lambda x: self.follow(Value(x, v.type.elementType), steps).col) if steps else v.col
        return Value(F.filter(mapped, lambda x: V.present(Value(x, element))), T.ArrayType(element))

    def _index(self, node: Node, here: Value, top: bool) -> Value:
        return here.item(node.value)

    def _list(self, node: Node, here: Value, top: bool) -> Value:
        return self._unless_null(here, V.array([self.run(p, here, top) for p in node.parts], mixed=True))

    def _hash(self, node: Node, here: Value, top: bool) -> Value:
        return self._unless_null(here, V.struct({k: self.run(p, here, top) for k, p in zip(node.value, node.parts, strict=True)}))

    @staticmethod
    def _unless_null(here: Value, made: Value) -> Value:
        return V.null() if here.is_null else Value(F.when(here.col.isNotNull(), made.col), made.type)

    def _pipe(self, node: Node, here: Value, top: bool) -> Value:
        return self.run(node.parts[1], self.run(node.parts[0], here, top))

    def _either(self, node: Node, here: Value, top: bool) -> Value:
        a, b = (self.run(p, here) for p in node.parts)
        kind = V.joined(a.type, b.type)
        return Value(F.when(truthy(a), V.as_type(a, kind)).otherwise(V.as_type(b, kind)), kind)

    def _both(self, node: Node, here: Value, top: bool) -> Value:
        a, b = (self.run(p, here) for p in node.parts)
        kind = V.joined(a.type, b.type)
        return Value(F.when(truthy(a), V.as_type(b, kind)).otherwise(V.as_type(a, kind)), kind)

    def _not(self, node: Node, here: Value, top: bool) -> Value:
        return Value(~truthy(self.run(node.parts[0], here)), T.BooleanType())

    def _compare(self, node: Node, here: Value, top: bool) -> Value:
        return self._compared(node.kind, *(self.run(p, here) for p in node.parts))

    def _compared(self, op: str, a: Value, b: Value) -> Value:
        if op in ("==", "!="):
            same = equal(a, b)
            return Value(same if op == "==" else ~same, T.BooleanType())
        if isinstance(a.type, T.VariantType):
            return V.by_option(a, lambda x: self._compared(op, x, b))
        if isinstance(b.type, T.VariantType):
            return V.by_option(b, lambda x: self._compared(op, a, x))
        fits = (V.is_number(a.type) and V.is_number(b.type)) or (isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType))
        if not fits:
            return Value(F.lit(None).cast("boolean"), T.BooleanType())
        out = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
        return Value(out, T.BooleanType())

    def _call(self, node: Node, here: Value, top: bool) -> Value:
        if node.value not in FUNCTIONS:
            raise self.fail(f"unknown function {node.value!r}")
        least, most, f = FUNCTIONS[node.value]
        if not least <= len(node.parts) <= (most or len(node.parts)):
            raise self.fail(f"{len(node.parts)} arguments for {node.value}()")
        arguments = [(lambda v, p=p: self.run(p.parts[0], v)) if p.kind == "&" else self.run(p, here) for p in node.parts]
        try:
            return self._spread(f, node.value, arguments)
        except _Wrong as e:
            raise self.fail(f"{node.value}() can't take {e}") from None

    def _spread(self, f, name: str, arguments: list) -> Value:
        """A function of values of which some are mixed: planned for each type they may have."""
        for i, v in enumerate(arguments):
            if isinstance(v, Value) and isinstance(v.type, T.VariantType):
                one = lambda x, i=i: self._spread(f, name, [*arguments[:i], x, *arguments[i + 1 :]])
                return V.by_option(v, one, _Wrong, f"{name}() can't take")
        return f(*arguments)


_METHODS = {
    "@": "here", "|": "pipe", "||": "either", "&&": "both", "!": "not",
    **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), "compare"),
}


def _slice(a: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    """A Python slice of an array."""
    n, step = F.size(a), 1 if step is None else step

    def bound(i: int | None, low: Column, high: Column, default: Column) -> Column:
        return default if i is None else F.least(F.greatest(F.lit(i) + (n if i < 0 else F.lit(0)), low), high)

    zero, end = F.lit(0), n - 1
    if step > 0:
        first, last = bound(start, zero, n, zero), bound(stop, zero, n, n) - 1
        at = V.sequence(first, last)
        picked = F.filter(at, lambda i: (i - first) % step == 0)
    else:
        first, last = bound(start, F.lit(-1), end, end), bound(stop, F.lit(-1), end, F.lit(-1)) + 1
        at = F.reverse(V.sequence(last, first))
        picked = F.filter(at, lambda i: (first - i) % -step == 0)
    return F.when(a.isNotNull(), F.transform(picked, lambda i: F.get(a, i)))


class _Wrong(Exception):
    """An argument of a type that a function has no meaning for."""


def _need(v: Value, *kinds: type) -> Value:
    if not isinstance(v, Value) or not isinstance(v.type, kinds):
        raise _Wrong("an expression" if not isinstance(v, Value) else v.type.simpleString())
    return v


def _numbers(v: Value) -> Value:
    _need(v, T.ArrayType)
    if not isinstance(v.type.elementType, (T.NumericType, T.NullType)):
        raise _Wrong(v.type.simpleString())
    return v


def _of(f, *kinds: type):
    def one(v: Value) -> Value:
        return Value(f(_need(v, *kinds).col), v.type)

    return one


def _whole(f):
    def one(v: Value) -> Value:
        return Value(f(_need(v, T.NumericType).col).cast("long"), T.LongType())

    return one


def _alike(f):
    """A function of arrays of numbers or texts; an array of mixed elements must have one kind of them."""

    def one(v: Value) -> Value:
        if isinstance(_need(v, T.ArrayType).type.elementType, Mixed):
            return V.of_one_type(v, f, "elements of types that can't be taken together", _Wrong)
        return f(v)

    return one


def _sum(v: Value) -> Value:
    kind = T.LongType() if V.is_integer(_numbers(v).type.elementType) else T.DoubleType()
    zero = F.lit(0).cast(kind)
    return Value(F.aggregate(v.col, zero, lambda a, x: a + x.cast(kind)), kind)


def _avg(v: Value) -> Value:
    total = F.aggregate(_numbers(v).col, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return Value(F.when(F.size(v.col) > 0, total / F.size(v.col)), T.DoubleType())


def _extreme(f):
    def one(v: Value) -> Value:
        return Value(f(_need(v, T.ArrayType).col), v.type.elementType)

    return one


def _sorted_places(v: Value, key, descending_ties: bool = False) -> Column:
    """The places of an array's elements in the order of their keys; ties keep their order, or turn it."""
    element = _need(v, T.ArrayType).type.elementType
    sign = -1 if descending_ties else 1
    keyed = F.transform(v.col, lambda x, i: F.struct(key(Value(x, element)).col.alias("k"), (i * sign).alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"] * sign)


def _sort_by(v: Value, key) -> Value:
    return Value(F.transform(_sorted_places(v, key), lambda i: F.get(v.col, i)), v.type)


def _by(last: bool):
    def one(v: Value, key) -> Value:
        places = _sorted_places(v, key, descending_ties=last)
        return Value(F.get(v.col, F.try_element_at(places, F.lit(-1)) if last else F.get(places, F.lit(0))), v.type.elementType)

    return one


def _contains(v: Value, x: Value) -> Value:
    if isinstance(v.type, T.StringType):
        found = v.col.contains(x.col) if isinstance(x.type, T.StringType) else F.lit(False)
    else:
        element = _need(v, T.ArrayType).type.elementType
        found = F.exists(v.col, lambda y: equal(Value(y, element), x))
    return Value(found, T.BooleanType())


def _text_test(name: str):
    def one(v: Value, x: Value) -> Value:
        return Value(getattr(_need(v, T.StringType).col, name)(_need(x, T.StringType).col), T.BooleanType())

    return one


def _failing(why: str, v: Value) -> Value:
    """An array of texts, if there were any: an error for each row that has other elements."""
    return Value(F.when(F.size(v.col) > 0, F.raise_error(F.lit(why)).cast("array<string>")).otherwise(F.array().cast("array<string>")), T.ArrayType(T.StringType()))


def _join(glue: Value, v: Value) -> Value:
    _need(glue, T.StringType), _need(v, T.ArrayType)
    if isinstance(v.type.elementType, Mixed):
        return V.of_one_type(v, lambda x: _join(glue, x if isinstance(x.type.elementType, T.StringType) else _failing("join() can't take numbers", x)), "join() takes texts only")
    if not isinstance(v.type.elementType, T.StringType):
        raise _Wrong(v.type.simpleString())
    whole = F.aggregate(v.col, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, glue.col, x)))
    return Value(F.when(F.size(v.col) > 0, whole).otherwise(F.when(v.col.isNotNull(), F.lit(""))), T.StringType())


def _length(v: Value) -> Value:
    _need(v, T.StringType, T.ArrayType, T.MapType, T.StructType)
    if isinstance(v.type, T.StructType):
        return Value(F.when(v.col.isNotNull(), F.lit(len(v.type.names)).cast("long")), T.LongType())
    n = F.length(v.col) if isinstance(v.type, T.StringType) else F.when(v.col.isNotNull(), F.size(v.col))
    return Value(n.cast("long"), T.LongType())


def _keys(v: Value) -> Value:
    if isinstance(_need(v, T.StructType, T.MapType).type, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(v.type.keyType))
    return Value(F.when(v.col.isNotNull(), F.array(*map(F.lit, v.type.names))), T.ArrayType(T.StringType()))


def _values(v: Value) -> Value:
    return _Compiler("values(@)")._values_of(_need(v, T.StructType, T.MapType))


def _map(key, v: Value) -> Value:
    element = _need(v, T.ArrayType).type.elementType
    kind = key(Value(F.lit(None).cast(element), element)).type
    return Value(F.transform(v.col, lambda x: key(Value(x, element)).col), T.ArrayType(kind))


def _merge(*vs: Value) -> Value:
    if all(isinstance(v.type, T.StructType) for v in vs):
        return V.struct({n: v.field(n) for v in vs for n in v.type.names})
    out = _need(vs[0], T.MapType)
    for v in vs[1:]:
        out = _map_merge(out, _need(v, T.MapType))
    return out


def _map_merge(a: Value, b: Value) -> Value:
    """Entries of both maps, b's where both have one; joining maps that share a key is an error in Spark."""
    return Value(F.map_concat(F.map_filter(a.col, lambda k, _: ~F.map_contains_key(b.col, k)), b.col), a.type)


def _not_null(*vs: Value) -> Value:
    kind = V.all_joined(v.type for v in vs)
    return Value(F.coalesce(*[V.as_type(v, kind) for v in vs]), kind)


def _to_array(v: Value) -> Value:
    return v if isinstance(v.type, T.ArrayType) else Value(F.array(v.col), T.ArrayType(v.type))


def _to_number(v: Value) -> Value:
    if V.is_number(v.type):
        return v
    if isinstance(v.type, T.StringType):
        return Value(v.col.try_cast("double"), T.DoubleType())
    return Value(F.lit(None).cast("double"), T.DoubleType())


def _to_string(v: Value) -> Value:
    if isinstance(v.type, T.StringType):
        return v
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return Value(F.to_json(v.col, {"ignoreNullFields": "false"}), T.StringType())
    return Value(F.coalesce(v.col.cast("string"), F.lit("null")), T.StringType())


def _type(v: Value) -> Value:
    t = v.type
    name = (
        "string" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "number" if V.is_number(t)
        else "array" if isinstance(t, T.ArrayType) else "null" if isinstance(t, T.NullType) else "object"
    )
    return Value(F.when(v.col.isNull(), "null").otherwise(name), T.StringType())


#: Name: least and most arguments (0: any number), function.
FUNCTIONS = {
    "abs": (1, 1, _of(F.abs, T.NumericType)), "ceil": (1, 1, _whole(F.ceil)), "floor": (1, 1, _whole(F.floor)),
    "avg": (1, 1, _alike(_avg)), "sum": (1, 1, _alike(_sum)), "max": (1, 1, _alike(_extreme(F.array_max))), "min": (1, 1, _alike(_extreme(F.array_min))),
    "max_by": (2, 2, _by(True)), "min_by": (2, 2, _by(False)), "sort": (1, 1, _alike(_of(F.array_sort, T.ArrayType))), "sort_by": (2, 2, _sort_by),
    "contains": (2, 2, _contains), "starts_with": (2, 2, _text_test("startswith")), "ends_with": (2, 2, _text_test("endswith")),
    "join": (2, 2, _join), "length": (1, 1, _length), "reverse": (1, 1, _of(F.reverse, T.StringType, T.ArrayType)),
    "keys": (1, 1, _keys), "values": (1, 1, _values), "map": (2, 2, _map), "merge": (1, 0, _merge), "not_null": (1, 0, _not_null),
    "to_array": (1, 1, _to_array), "to_number": (1, 1, _to_number), "to_string": (1, 1, _to_string), "type": (1, 1, _type),
}
