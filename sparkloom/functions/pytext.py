"""The texts that Python's ``str``, ``repr`` and ``json.dumps`` give for values, in built-in functions only.

What is written follows from the type at plan time, down to the fields of nested structs, so no value leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.values import Mixed, Pair, PlanError, Value, by_option, is_integer


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_str(v: Value) -> Column:
    """The text that Python's ``str`` gives for a value; ``None`` for null."""
    t = v.type
    if isinstance(t, T.NullType):
        return F.lit("None")
    if isinstance(t, Mixed):
        text = by_option(v, lambda x: Value(py_str(x), T.StringType())).col
    elif isinstance(t, T.StringType):
        text = v.col
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(v.col, "yyyy-MM-dd HH:mm:ss")
        text = F.when(F.date_format(v.col, "SSSSSS") == "000000", whole).otherwise(F.date_format(v.col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    elif isinstance(t, (T.DateType, T.DecimalType)):
        text = v.col.cast("string")
    else:
        return py_repr(v)
    return F.coalesce(text, F.lit("None"))


def py_repr(v: Value) -> Column:
    """The text of a value inside a container."""
    t = v.type
    if isinstance(t, T.NullType):
        return F.lit("None")
    if isinstance(t, T.StringType):
        text = _quoted(v.col)
    elif isinstance(t, T.BooleanType):
        text = F.when(v.col, "True").when(~v.col, "False")
    elif is_integer(t):
        text = v.col.cast("string")
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        text = shortest(v.col)
    elif isinstance(t, T.DecimalType):
        text = F.concat(F.lit("Decimal('"), v.col.cast("string"), F.lit("')"))
    elif isinstance(t, T.DateType):
        text = F.concat(F.lit("datetime.date("), F.date_format(v.col, "y, M, d"), F.lit(")"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(v.col, "SSSSSS").cast("int")
        rest = F.when(micros > 0, F.concat(F.date_format(v.col, ", s, "), micros.cast("string"))).when(F.second(v.col) > 0, F.date_format(v.col, ", s")).otherwise("")
        text = F.concat(F.lit("datetime.datetime("), F.date_format(v.col, "y, M, d, H, m"), rest, F.lit(")"))
    elif isinstance(t, T.BinaryType):
        text = _bytes(v.col)
    elif isinstance(t, Mixed):
        text = by_option(v, lambda x: Value(py_repr(x), T.StringType())).col
    elif isinstance(t, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: py_repr(Value(x, t.elementType))), ", "), F.lit("]"))
    elif isinstance(t, Pair):
        text = F.when(v.col.isNotNull(), F.concat(F.lit("("), py_repr(v.field(t.names[0])), F.lit(", "), py_repr(v.field(t.names[1])), F.lit(")")))
    elif isinstance(t, T.StructType):
        parts = [x for i, n in enumerate(t.names) for x in (F.lit(f"{', ' if i else ''}{n!r}: "), py_repr(v.field(n)))]
        text = F.when(v.col.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(t, T.MapType):
        pair = lambda e: F.concat(py_repr(Value(e["key"], t.keyType)), F.lit(": "), py_repr(Value(e["value"], t.valueType)))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(v.col), pair), ", "), F.lit("}"))
    else:
        raise PlanError(f"no text for a {t.simpleString()}")
    return F.coalesce(text, F.lit("None"))


def _by_char(text: Column, odd: str, code: Callable[[Column], Column]) -> Column:
    """``text`` with each character that matches ``odd`` replaced; it is only cut into characters if it has one."""
    each = lambda c: F.when(c.rlike(odd), code(c)).otherwise(c)
    return F.when(text.rlike(odd), F.array_join(F.transform(F.split(text, ""), each), "")).otherwise(text)


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), digits, "0")


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _quoted(text: Column) -> Column:
    text = _replaced(text, (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))

    def code(c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 256, F.concat(F.lit("\\x"), _hex(n, 2))).when(n < 65536, F.concat(F.lit("\\u"), _hex(n, 4))).otherwise(F.concat(F.lit("\\U"), _hex(n, 8)))

    text = _by_char(text, r"[\p{C}\p{Z}&&[^ ]]", code)  # what Python doesn't print
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _bytes(data: Column) -> Column:
    def one(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("int")
        plain = F.when(n == 92, "\\\\").when(n == 9, "\\t").when(n == 10, "\\n").when(n == 13, "\\r").when((n >= 32) & (n < 127), F.char(n))
        return F.coalesce(plain, F.concat(F.lit("\\x"), F.lower(h)))

    text = F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1), one), "")
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('b"'), text, F.lit('"'))).otherwise(F.concat(F.lit("b'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def shortest(x: Column) -> Column:
    """Python's text of a double: the fewest digits that give it back, with an exponent below 1e-4 and from 1e16."""
    x = x.cast("double")
    own = x.cast("string")
    plain = F.when(own == "NaN", "nan").when(own == "Infinity", "inf").when(own == "-Infinity", "-inf").when(own.contains("E") | (F.length(own) >= 17), _spelled(x, own))
    return F.coalesce(plain, own)  # most have neither an exponent nor so many digits that one might be too many


def _spelled(x: Column, own: Column) -> Column:
    """From Java's text of a double, which may have a digit or two more than are needed."""
    bare = F.replace(own, F.lit("-"), F.lit(""))
    whole, part = F.regexp_extract(bare, r"^(\d+)\.", 1), F.regexp_extract(bare, r"\.(\d+)", 1)
    power = F.coalesce(F.regexp_extract(own, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    zeros = F.length(F.regexp_extract(part, "^(0*)", 1))
    first = F.when(whole != "0", power + F.length(whole) - 1).otherwise(power - zeros - 1)
    digits = F.regexp_replace(F.regexp_replace(F.concat(whole, part), "^0+(?=.)", ""), "(?<=.)0+$", "")
    read = F.struct(digits.alias("d"), first.alias("p"))
    shorter = F.when(F.abs(x).between(2.0**53, 9.2e18), let(F.abs(x).cast("long"), lambda n: _rounded(n, F.abs(x))))
    shorter = shorter.otherwise(let(let(read, lambda s: _one_less(s, F.abs(x))), lambda s: _one_less(s, F.abs(x))))
    sign = F.when(own.startswith("-"), "-").otherwise("")
    return F.concat(sign, let(shorter, lambda s: _written(s["d"], s["p"])))


def _rounded(n: Column, x: Column) -> Column:
    """Digits and power of the roundest whole number that gives ``x``, of those next to its exact value ``n``."""
    made = lambda m: F.struct(F.regexp_replace(m.cast("string"), "(?<=.)0+$", "").alias("d"), (F.length(m.cast("string")) - 1).alias("p"))
    out = made(n)
    for zeros in range(1, 19):
        near = F.bround(n.cast("decimal(20,0)"), -zeros).cast("decimal(20,0)")
        out = F.when(near.cast("double") == x, made(near)).otherwise(out)
    return out


def _one_less(s: Column, x: Column) -> Column:
    """Digits and power with one digit less, if that gives ``x`` too."""
    n = F.length(s["d"])
    low = F.substring(s["d"], F.lit(1), n - 1).try_cast("long")
    text = lambda m: F.regexp_replace(m.cast("string"), "(?<=.)0+$", "")
    fits = lambda m: F.concat(m.cast("string"), F.lit("E"), (s["p"] - n + 2).cast("string")).try_cast("double") == x
    made = lambda m: F.struct(text(m).alias("d"), (s["p"] + F.length(m.cast("string")) - (n - 1)).alias("p"))
    up = F.substring(s["d"], n, F.lit(1)) >= "5"
    near, far = F.when(up, low + 1).otherwise(low), F.when(up, low).otherwise(low + 1)
    return F.when(n < 2, s).when(fits(near), made(near)).when(fits(far), made(far)).otherwise(s)


def _written(digits: Column, power: Column) -> Column:
    n = F.length(digits)
    fixed = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= n - 1, F.concat(digits, F.repeat(F.lit("0"), power - n + 1), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n)))
    )
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    size = F.abs(power).cast("string")
    short = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
    return F.when((power >= -4) & (power < 16), fixed).otherwise(short)


_JSON_MARKS = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_text(text: Column) -> Column:
    """ASCII only: what is beyond becomes one or two UTF-16 units."""

    def code(c: Column) -> Column:
        n = F.ascii(c)
        unit = lambda x: F.concat(F.lit("\\u"), _hex(x, 4))
        over = n - 65536
        return F.when(n < 65536, unit(n)).otherwise(F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00)))

    return F.concat(F.lit('"'), _by_char(_replaced(text, _JSON_MARKS), r"[^\x20-\x7E]", code), F.lit('"'))


def bracketed(opening: str, close: str, items: Column, indent: str | None, depth: int) -> Column:
    """Items of JSON between brackets, on lines of their own if there is an indent."""
    gap, end = ("", "") if indent is None else (f"\n{indent * (depth + 1)}", f"\n{indent * depth}")
    text = F.array_join(items, ", " if indent is None else f",{gap}")
    return F.when(F.size(items) == 0, opening + close).otherwise(F.concat(F.lit(opening + gap), text, F.lit(end + close)))


def py_json(v: Value, indent: str | None = None, depth: int = 0) -> Column:
    """The text of ``json.dumps(value, sort_keys=True, indent=indent)``."""
    t = v.type
    if isinstance(t, T.NullType):
        return F.lit("null")
    if isinstance(t, Mixed):
        text = by_option(v, lambda x: Value(py_json(x, indent, depth), T.StringType())).col
    elif isinstance(t, T.StringType):
        text = json_text(v.col)
    elif isinstance(t, T.BooleanType):
        text = v.col.cast("string")
    elif is_integer(t):
        text = v.col.cast("string")
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        raw = shortest(v.col)
        text = F.when(raw == "nan", "NaN").when(raw == "inf", "Infinity").when(raw == "-inf", "-Infinity").otherwise(raw)
    elif isinstance(t, T.ArrayType):
        each = F.transform(v.col, lambda x: py_json(Value(x, t.elementType), indent, depth + 1))
        text = F.when(v.col.isNotNull(), bracketed("[", "]", each, indent, depth))
    elif isinstance(t, Pair):
        text = F.when(v.col.isNotNull(), bracketed("[", "]", F.array(*[py_json(v.field(n), indent, depth + 1) for n in t.names]), indent, depth))
    elif isinstance(t, T.StructType):
        each = F.array(*[F.concat(json_text(F.lit(n)), F.lit(": "), py_json(v.field(n), indent, depth + 1)) for n in sorted(t.names)])
        text = F.when(v.col.isNotNull(), bracketed("{", "}", each, indent, depth) if t.names else F.lit("{}"))
    elif isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        keys = F.array_sort(F.map_keys(v.col))
        each = F.transform(keys, lambda k: F.concat(json_text(k), F.lit(": "), py_json(Value(F.element_at(v.col, k), t.valueType), indent, depth + 1)))
        text = F.when(v.col.isNotNull(), bracketed("{", "}", each, indent, depth))
    else:
        raise PlanError(f"no JSON text for a {t.simpleString()}")
    return F.coalesce(text, F.lit("null"))
