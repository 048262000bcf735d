"""Typed values: a Column together with the type it has at plan time.

A value that may be of one of several types that don't unify is a VARIANT whose possible types are known
(:class:`Mixed`). What is done with it is planned for each of them and chosen, row by row, by the type that is there.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlanError(ValueError):
    """An expression, template or configuration that can't be planned."""


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    defined: bool = True

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    def field(self, name: str) -> Value:
        """A struct's field or a map's entry; null where the type has none."""
        if isinstance(self.type, T.VariantType):
            return by_option(self, lambda v: v.field(name))
        if isinstance(self.type, T.StructType) and name in self.type.names:
            return Value(self.col.getField(name), self.type[name].dataType)
        if isinstance(self.type, T.MapType) and isinstance(self.type.keyType, T.StringType):
            return Value(F.try_element_at(self.col, F.lit(name)), self.type.valueType)
        return null()

    def item(self, i: int) -> Value:
        """An array's element, from the end if negative; null where there is none."""
        if isinstance(self.type, T.VariantType):
            return by_option(self, lambda v: v.item(i))
        if not isinstance(self.type, T.ArrayType):
            return null()
        return Value(F.get(self.col, F.lit(i)) if i >= 0 else F.try_element_at(self.col, F.lit(i)), self.type.elementType)


def null() -> Value:
    return Value(F.lit(None), T.NullType())


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def literal(x: Any, mixed: bool = False) -> Value:
    """A constant of JSON or YAML. ``mixed``: whether the elements of a list may differ in type."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        return Value(F.lit(x).cast("long"), T.LongType())
    if isinstance(x, float):
        return Value(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Value(F.lit(x), T.StringType())
    if isinstance(x, datetime.datetime):
        return Value(F.lit(x), T.TimestampType())
    if isinstance(x, datetime.date):
        return Value(F.lit(x), T.DateType())
    if isinstance(x, list):
        return array([literal(v, mixed) for v in x], mixed)
    if isinstance(x, dict):
        return struct({k: literal(v, mixed) for k, v in x.items()})
    raise PlanError(f"no literal of type {type(x).__name__}")


def unify(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both can have without a change of value, or None."""
    if type(a) is T.VariantType or type(b) is T.VariantType:  # holds anything
        return T.VariantType()
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if is_number(a) and is_number(b):
        return T.LongType() if is_integer(a) and is_integer(b) else T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        element = unify(a.elementType, b.elementType)
        return element and T.ArrayType(element)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        fields = [(n, unify(a[n].dataType, b[n].dataType)) for n in a.names]
        return T.StructType([T.StructField(n, t) for n, t in fields]) if all(t for _, t in fields) else None
    return None


class Mixed(T.VariantType):
    """A VARIANT that holds a value of one of ``options``. At most one of them is an array, and none is mixed itself."""

    def __init__(self, options: tuple[T.DataType, ...] = ()):
        self.options = options

    @classmethod
    def typeName(cls) -> str:
        return "variant"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Mixed) and set(map(_ddl, self.options)) == set(map(_ddl, other.options))

    def __hash__(self) -> int:
        return hash(self.typeName())


class Pair(T.StructType):
    """A struct that stands for a tuple of Python."""

    @classmethod
    def typeName(cls) -> str:
        return "struct"


def options(t: T.VariantType) -> tuple[T.DataType, ...]:
    """The types that a VARIANT may have; one of the source's may have any that JSON has, and VARIANTs inside."""
    if isinstance(t, Mixed):
        return t.options
    inner = T.VariantType()
    return (T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType(), T.ArrayType(inner), T.MapType(T.StringType(), inner))


def is_mixed(t: T.DataType) -> bool:
    """Whether a mixed type is in it, at any depth."""
    if isinstance(t, T.ArrayType):
        return is_mixed(t.elementType)
    if isinstance(t, T.MapType):
        return is_mixed(t.valueType)
    return isinstance(t, T.VariantType) or isinstance(t, T.StructType) and any(is_mixed(f.dataType) for f in t.fields)


def _options(t: T.DataType) -> tuple[T.DataType, ...]:
    return options(t) if isinstance(t, T.VariantType) else () if isinstance(t, T.NullType) else (t,)


def joined(a: T.DataType, b: T.DataType) -> T.DataType:
    return all_joined((a, b))


def all_joined(types: Iterable[T.DataType]) -> T.DataType:
    """The type that holds values of all: the one they unify to, or a mixed one, in which whole numbers and others stay apart."""
    types = list(types)
    found: T.DataType | None = T.NullType()
    for t in types:
        found = found if found is None else unify(found, t)
    if found is not None:
        return found
    out: list[list[T.DataType]] = []  # options, each with the types that make it up
    for t in (o for t in types for o in _options(t)):
        t = T.LongType() if is_integer(t) else T.DoubleType() if isinstance(t, T.FloatType) else t
        for own in out:
            if t == own[0] or isinstance(t, T.ArrayType) and isinstance(own[0], T.ArrayType) or isinstance(t, T.StructType) and isinstance(own[0], T.StructType) and t.names == own[0].names:
                own.append(t)
                break
        else:
            out.append([t])
    options = [_together(own) for own in out]
    if len({type(t) for t in options if isinstance(t, (T.StructType, T.MapType))}) > 1:
        raise PlanError("an object with known names and one without can't be told apart")
    return Mixed(tuple(options)) if len(options) > 1 else options[0]


def _together(types: list[T.DataType]) -> T.DataType:
    """One array or struct type for several."""
    if isinstance(types[0], T.ArrayType):
        return T.ArrayType(all_joined(t.elementType for t in types))
    if isinstance(types[0], T.StructType):
        return T.StructType([T.StructField(n, all_joined(t[n].dataType for t in types)) for n in types[0].names])
    return types[0]


def as_type(v: Value, t: T.DataType) -> Column:
    if v.type == t:
        return v.col
    if isinstance(t, T.VariantType):
        if v.is_null or isinstance(v.type, T.VariantType):
            return v.col.cast("variant")
        if isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_variant_object(v.col)
        whole = is_integer(v.type) and T.LongType() in options(t)
        return v.col.cast("long" if whole else "double" if is_number(v.type) and not isinstance(v.type, T.DecimalType) else v.type).cast("variant")
    if is_mixed(t) and isinstance(v.type, T.ArrayType) and isinstance(t, T.ArrayType):
        return F.transform(v.col, lambda x: as_type(Value(x, v.type.elementType), t.elementType))
    if is_mixed(t) and isinstance(v.type, T.StructType) and isinstance(t, T.StructType):
        return F.when(v.col.isNotNull(), F.struct(*[as_type(v.field(f.name), f.dataType).alias(f.name) for f in t.fields]))
    return v.col.cast(t)


def _ddl(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"array<{_ddl(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"map<{_ddl(t.keyType)},{_ddl(t.valueType)}>"
    if isinstance(t, T.StructType):
        fields = ",".join("`{}`:{}".format(f.name.replace("`", "``"), _ddl(f.dataType)) for f in t.fields)
        return f"struct<{fields}>"
    return t.simpleString()


def is_option(v: Value, t: T.DataType) -> Column:
    """Whether a mixed value is of this type of its options. Null is of none."""
    kind = F.schema_of_variant(v.col)
    if isinstance(t, T.ArrayType):
        return kind.startswith("ARRAY")
    if isinstance(t, (T.StructType, T.MapType)):
        found = kind.startswith("OBJECT")
        if sum(isinstance(o, T.StructType) for o in options(v.type)) > 1:
            found = found & (F.array_sort(F.json_object_keys(F.to_json(v.col))) == F.array(*map(F.lit, sorted(t.names))))
        return found
    if isinstance(t, T.DecimalType):
        return kind.startswith("DECIMAL")
    if isinstance(t, T.DoubleType) and not isinstance(v.type, Mixed):  # as JSON's fractions are parsed
        return kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return kind == {T.LongType: "BIGINT"}.get(type(t), t.simpleString().upper())


def option(v: Value, t: T.DataType) -> Value:
    """A mixed value as one of its options; null if it is of another."""
    return Value(F.try_variant_get(v.col, "$", _ddl(t)), t)


def present(v: Value) -> Column:
    return v.col.isNotNull() & ~F.is_variant_null(v.col) if isinstance(v.type, T.VariantType) else v.col.isNotNull()


def by_option(v: Value, use: Callable[[Value], Value], wrong: type[Exception] = (), why: str = "") -> Value:
    """``use`` for each type that ``v`` may have, and for null. If it has one for which ``use`` raises ``wrong``, that is an error when it runs."""
    made: list[tuple[T.DataType, Value | None]] = []
    for t in options(v.type):
        try:
            made.append((t, use(option(v, t))))
        except wrong:
            made.append((t, None))
    if all(r is None for _, r in made):
        return use(option(v, options(v.type)[0]))
    try:
        absent = use(null())
    except wrong:
        absent = null()
    return _chosen([(is_option(v, t), r, f"{why} {t.simpleString()}") for t, r in made], absent)


def _chosen(cases: list[tuple[Column, Value | None, str]], absent: Value) -> Value:
    kind = all_joined([*(r.type for _, r, _ in cases if r is not None), absent.type])
    if isinstance(kind, T.NullType) and all(r is not None for _, r, _ in cases):
        return null()
    kind = T.StringType() if isinstance(kind, T.NullType) else kind
    out = F.when(F.lit(False), F.lit(None).cast(kind))
    for condition, r, why in cases:
        out = out.when(condition, as_type(r, kind) if r is not None else F.raise_error(F.lit(why.strip())).cast(kind))
    return Value(out if absent.is_null else out.otherwise(as_type(absent, kind)), kind)


def _is_any(t: Mixed, members: list[T.DataType]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda a, b: a | b, [is_option(Value(x, t), m) for m in members])


def _as_any(t: Mixed, members: list[T.DataType], kind: T.DataType) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(*[option(Value(x, t), m).col.cast(kind) for m in members])


def of_one_type(v: Value, use: Callable[[Value], Value], why: str, wrong: type[Exception] = ()) -> Value:
    """``use`` of an array of mixed values that has numbers only, or texts only; others, and what ``use`` raises ``wrong`` for, are an error when it runs."""
    if not isinstance(v.type.elementType, Mixed):
        return use(v)
    inner = v.type.elementType
    numbers = [t for t in inner.options if is_number(t)]
    groups = ([(numbers, T.LongType() if all(map(is_integer, numbers)) else T.DoubleType())] if numbers else []) + [([t], t) for t in inner.options if isinstance(t, T.StringType)]
    cases: list[tuple[Column, Value | None, str]] = []
    for members, kind in groups:
        try:
            made = use(Value(F.transform(v.col, _as_any(inner, members, kind)), T.ArrayType(kind)))
        except wrong:
            made = None
        cases.append((F.forall(v.col, _is_any(inner, members)), made, why))
    if all(r is None for _, r, _ in cases):
        return use(Value(v.col, T.ArrayType(inner.options[0])))
    return _chosen([*cases, (v.col.isNotNull(), None, why)], null())


def array(values: list[Value], mixed: bool = False) -> Value:
    """An array of values that unify, or, if ``mixed``, of any."""
    element: T.DataType = T.NullType()
    if mixed:
        element = all_joined(v.type for v in values)
    for v in () if mixed else values:
        found = unify(element, v.type)
        if found is None:
            raise PlanError(f"array elements of types {element.simpleString()} and {v.type.simpleString()} don't unify")
        element = found
    return Value(F.array(*[as_type(v, element) for v in values]), T.ArrayType(element))


def described(t: T.DataType) -> Any:
    """A type as JSON, the options of mixed ones included."""
    if isinstance(t, Mixed):
        return {"mixed": [described(o) for o in t.options]}
    if isinstance(t, T.ArrayType):
        return {"array": described(t.elementType)}
    if isinstance(t, T.StructType):
        return {"struct": [[f.name, described(f.dataType)] for f in t.fields]}
    return t.json()


def from_description(x: Any) -> T.DataType:
    if isinstance(x, str):
        return T._parse_datatype_json_string(x)
    if "mixed" in x:
        return Mixed(tuple(map(from_description, x["mixed"])))
    if "array" in x:
        return T.ArrayType(from_description(x["array"]))
    return T.StructType([T.StructField(n, from_description(t)) for n, t in x["struct"]])


def struct(values: dict[str, Value]) -> Value:
    kind = T.StructType([T.StructField(k, v.type) for k, v in values.items()])
    return Value(F.struct(*[v.col.alias(k) for k, v in values.items()]), kind)


def sequence(first: Column, last: Column) -> Column:
    """The integers from first to last; none if last is smaller (``sequence`` would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
