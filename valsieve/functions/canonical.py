"""Canonical JSON of nested values as column expressions.

The text is that of a compact JSON writer with sorted keys: fields of structs and
keys of maps in code point order at every depth, no blanks, letters outside ASCII as they
are.  Doubles have the digits that Spark gives them: plain from 1e-4 up to below 1e16
and with at least one decimal, otherwise as mantissa and exponent of at least two digits
(``1e-05``, ``1.5e+16``).  Missing values are ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of JSON.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def text_json(value: Column) -> Column:
    """A string in quotes, with escapes."""
    short = value
    for plain, escaped in ESCAPES.items():
        short = F.replace(short, F.lit(plain), F.lit(escaped))
    full = short
    for code in range(32):
        if chr(code) not in ESCAPES:
            full = F.replace(full, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    rare = value.rlike(r"[\x00-\x07\x0b\x0e-\x1f]")
    return F.concat(F.lit('"'), F.when(rare, full).otherwise(short), F.lit('"'))


def double_json(value: Column) -> Column:
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    digits = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long = F.when(F.abs(power) > 99, F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(exponent)
    return (
        F.when(F.isnan(value.cast("double")) | (size == float("inf")) | (size == 0), text)
        .when((size >= 1e-4) & (size < 1e16), plain).otherwise(long))


def joined(parts: Column, opening: str, closing: str) -> Column:
    return F.concat(F.lit(opening), F.array_join(parts, ","), F.lit(closing))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of type ``kind``; other types than those of JSON are an error."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = F.array(*[F.concat(text_json(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields])
        text = joined(parts, "{", "}") if fields else F.lit("{}")
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        keys = F.array_sort(F.map_keys(value))
        entry = lambda k: F.concat(text_json(k), F.lit(":"), canonical_json(F.element_at(value, k), kind.valueType))
        text = joined(F.transform(keys, entry), "{", "}")
    elif isinstance(kind, T.ArrayType):
        text = joined(F.transform(value, lambda x: canonical_json(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.StringType):
        text = text_json(value)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = value.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        text = double_json(value)
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)
