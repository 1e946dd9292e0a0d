"""Ranges as structs (lower, upper, lower_inc, upper_inc, empty), and their predicates.

Null bounds are infinite. Discrete ranges (whole numbers, dates) are brought to [lower, upper)
before they are compared, so [1,3] and [1,4) are one range. A predicate on an empty range is
false, except that every range contains it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import bad_request

FIELDS = ("lower", "upper", "lower_inc", "upper_inc", "empty")


def struct_of(kind: T.DataType) -> T.StructType:
    flag = T.BooleanType()
    return T.StructType([T.StructField("lower", kind), T.StructField("upper", kind), T.StructField("lower_inc", flag), T.StructField("upper_inc", flag), T.StructField("empty", flag)])


def is_range(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and tuple(kind.names) == FIELDS


def _discrete(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DateType))


def literal(text: str, kind: T.StructType, value_of) -> Column:
    """'[1,5)', '(,3]', 'empty'; a bare value is the range of that value alone."""
    of = kind["lower"].dataType
    s = str(text).strip()
    if s.lower() == "empty":
        return make(F.lit(None).cast(of), F.lit(None).cast(of), False, False, True)
    m = re.fullmatch(r"([\[(])\s*\"?([^,\"]*)\"?\s*,\s*\"?([^,\"]*)\"?\s*([\])])", s)
    if not m:
        v = F.lit(value_of(s, of)).cast(of)
        return canonical(make(v, v, True, True, False), of)
    low, high = (value_of(x, of) if x.strip() else None for x in (m[2], m[3]))
    if low is not None and high is not None and low > high:
        raise bad_request(f"range lower bound is above its upper bound: {text!r}")
    none = low is not None and low == high and (m[1], m[4]) != ("[", "]")
    r = make(F.lit(low).cast(of), F.lit(high).cast(of), m[1] == "[" and low is not None, m[4] == "]" and high is not None, none)
    return canonical(r, of)


def make(lower: Column, upper: Column, lower_inc: bool | Column = True, upper_inc: bool | Column = False, empty: bool | Column = False) -> Column:
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lower.alias("lower"), upper.alias("upper"), flag(lower_inc).alias("lower_inc"), flag(upper_inc).alias("upper_inc"), flag(empty).alias("empty"))


def canonical(r: Column, of: T.DataType) -> Column:
    """Discrete ranges to [lower, upper)."""
    if not _discrete(of):
        return r
    nxt = (lambda c: F.date_add(c, 1)) if isinstance(of, T.DateType) else (lambda c: (c + F.lit(1).cast(of)).cast(of))
    low = F.when(r["lower_inc"] | r["lower"].isNull(), r["lower"]).otherwise(nxt(r["lower"]))
    high = F.when(r["upper_inc"], nxt(r["upper"])).otherwise(r["upper"])
    return make(low, high, low.isNotNull(), False, r["empty"] | F.coalesce(low >= high, F.lit(False)))


def _or(c: Column, when_null: bool) -> Column:
    return F.coalesce(c, F.lit(when_null))


def _full(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"]


def _left_of(a: Column, b: Column) -> Column:
    return _full(a, b) & _or((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), False)


def _not_right(a: Column, b: Column) -> Column:
    within = (a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (~a["upper_inc"] | b["upper_inc"]))
    return _full(a, b) & F.when(b["upper"].isNull(), True).when(a["upper"].isNull(), False).otherwise(within)


def _not_left(a: Column, b: Column) -> Column:
    within = (a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (~a["lower_inc"] | b["lower_inc"]))
    return _full(a, b) & F.when(b["lower"].isNull(), True).when(a["lower"].isNull(), False).otherwise(within)


def _touch(a: Column, b: Column) -> Column:
    return _or((a["upper"] == b["lower"]) & (a["upper_inc"] != b["lower_inc"]), False)


def _on(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column, T.DataType], Column]:
    """The test on both ranges in canonical form, each made once for a row. Null if either is null."""

    def predicate(a: Column, b: Column, of: T.DataType) -> Column:
        pair = F.struct(canonical(a, of).alias("a"), canonical(b, of).alias("b"))
        return F.when(a.isNotNull() & b.isNotNull(), F.get(F.transform(F.array(pair), lambda p: test(p["a"], p["b"])), F.lit(0)))

    return predicate


#: a << b, a >> b, a &< b (does not extend to the right of b), a &> b, a -|- b (adjacent), a && b, a @> b, a <@ b
left_of = _on(_left_of)
right_of = _on(lambda a, b: _left_of(b, a))
not_right = _on(_not_right)
not_left = _on(_not_left)
adjacent = _on(lambda a, b: _full(a, b) & (_touch(a, b) | _touch(b, a)))
overlaps = _on(lambda a, b: _full(a, b) & ~_left_of(a, b) & ~_left_of(b, a))
contains = _on(lambda a, b: b["empty"] | (_not_right(b, a) & _not_left(b, a)))
contained = _on(lambda a, b: a["empty"] | (_not_right(a, b) & _not_left(a, b)))

PREDICATES = {"sl": left_of, "sr": right_of, "nxr": not_right, "nxl": not_left, "adj": adjacent, "ov": overlaps, "cs": contains, "cd": contained}
