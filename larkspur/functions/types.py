"""Type names, and text literals made values of a column's type.

A literal is converted on the driver and compared with the bare column, so that comparisons
reach the Parquet scan as pushed filters; a literal that does not fit is a 400.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import bad_request
from larkspur.functions import ranges

NAMES: dict[str, T.DataType] = {
    **dict.fromkeys(("smallint", "int2"), T.ShortType()),
    **dict.fromkeys(("int", "integer", "int4", "serial"), T.IntegerType()),
    **dict.fromkeys(("bigint", "int8", "bigserial"), T.LongType()),
    **dict.fromkeys(("real", "float4"), T.FloatType()),
    **dict.fromkeys(("double", "float8", "double precision", "float"), T.DoubleType()),
    **dict.fromkeys(("numeric", "decimal"), T.DecimalType(38, 10)),
    **dict.fromkeys(("bool", "boolean"), T.BooleanType()),
    **dict.fromkeys(("text", "varchar", "bpchar", "char", "name", "uuid", "json", "jsonb", "citext", "tsvector", "character varying", "timetz"), T.StringType()),
    "timestamptz": T.TimestampType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
    "bytea": T.BinaryType(),
    "vector": T.ArrayType(T.FloatType()),
    "int4range": ranges.struct_of(T.IntegerType()),
    "int8range": ranges.struct_of(T.LongType()),
    "numrange": ranges.struct_of(T.DoubleType()),
    "daterange": ranges.struct_of(T.DateType()),
    "tsrange": ranges.struct_of(T.TimestampNTZType()),
}


def type_of(name: str) -> T.DataType:
    """The Spark type of a type name; `x[]` and `_x` are arrays."""
    key = name.strip().lower()
    if key.endswith("[]"):
        return T.ArrayType(type_of(key[:-2]))
    if key.startswith("_"):
        return T.ArrayType(type_of(key[1:]))
    if m := re.fullmatch(r"(?:numeric|decimal)\((\d+),\s*(\d+)\)", key):
        return T.DecimalType(int(m[1]), int(m[2]))
    if key not in NAMES:
        raise bad_request(f"Unknown type {name}")
    return NAMES[key]


def name_of(kind: T.DataType) -> str:
    for name, t in NAMES.items():
        if t == kind:
            return name
    if isinstance(kind, T.ArrayType):
        return name_of(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    return kind.simpleString()


_TRUE, _FALSE = frozenset("t true y yes on 1".split()), frozenset("f false n no off 0".split())


def value_of(text: Any, kind: T.DataType) -> Any:
    """A Python value of the type, from text or from a JSON value."""
    if text is None:
        return None
    if isinstance(kind, T.StringType):
        if isinstance(text, bool):
            return "true" if text else "false"
        return text if isinstance(text, str) else str(text)
    if isinstance(kind, T.ArrayType):
        return [value_of(x, kind.elementType) for x in (text if isinstance(text, list) else array_items(text))]
    s = ("true" if text else "false") if isinstance(text, bool) else str(text).strip()
    try:
        if isinstance(kind, T.BooleanType):
            if s.lower() in _TRUE:
                return True
            if s.lower() in _FALSE:
                return False
            raise ValueError
        if isinstance(kind, T.IntegralType):
            if isinstance(text, float) and text.is_integer():
                return int(text)
            bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
            if not re.fullmatch(r"[+-]?\d+", s) or not -(1 << bits - 1) <= int(s) < 1 << bits - 1:
                raise ValueError
            return int(s)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(s)
        if isinstance(kind, T.DecimalType):
            return Decimal(s)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(s)
        if isinstance(kind, T.TimestampNTZType):
            return dt.datetime.fromisoformat(s).replace(tzinfo=None)
        if isinstance(kind, T.TimestampType):
            at = dt.datetime.fromisoformat(s)
            return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        if isinstance(kind, T.BinaryType):
            return bytes.fromhex(s[2:]) if s.startswith("\\x") else s.encode()
    except (ValueError, InvalidOperation):
        raise bad_request(f"invalid input for type {kind.simpleString()}: {text!r}") from None
    raise bad_request(f"No literal of type {kind.simpleString()}")


def lit(text: Any, kind: T.DataType) -> Column:
    """A literal of exactly the type, so that no cast stands on the column's side."""
    if ranges.is_range(kind):
        return ranges.literal(text, kind, value_of)
    if isinstance(kind, T.ArrayType):
        items = [lit(x, kind.elementType) for x in value_of(text, kind)]
        return F.array(*items).cast(kind)
    return F.lit(value_of(text, kind)).cast(kind)


def array_items(text: str) -> list[str | None]:
    """The items of an array literal: {a,"b,c",NULL}, nested ones kept as text; a JSON array is accepted too."""
    s = text.strip()
    if s.startswith("[") and s.endswith("]"):
        s = "{" + s[1:-1] + "}"
    if not (s.startswith("{") and s.endswith("}")):
        raise bad_request(f"malformed array literal: {text!r}")
    items: list[str | None] = []
    item, quoted, was_quoted, depth, i = "", False, False, 0, 1
    end = len(s) - 1

    def put() -> None:
        items.append(item if was_quoted else None if item.strip().upper() == "NULL" else item.strip())

    if not s[1:end].strip():
        return []
    while i < end:
        c = s[i]
        if c == "\\" and i + 1 < end:
            item += s[i + 1]
            i += 1
        elif c == '"':
            quoted, was_quoted = not quoted, True
        elif c == "," and not quoted and not depth:
            put()
            item, was_quoted = "", False
        else:
            depth += (c == "{") - (c == "}") if not quoted else 0
            item += c
        i += 1
    put()
    return items
