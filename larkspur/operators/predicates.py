"""Filter trees to Columns.

`not` wraps the whole comparison, so rows whose comparison is null stay out either way.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import TableDef
from larkspur.errors import bad_request
from larkspur.functions import fts, jsonpath, ranges
from larkspur.functions.types import array_items, lit
from larkspur.plans.ir import Field, Filter, Logic, Tree

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def and_all(columns: Iterable[Column]) -> Column:
    """True of none."""
    columns = list(columns)
    return functools.reduce(operator.and_, columns) if columns else F.lit(True)


def or_all(columns: Iterable[Column]) -> Column:
    """False of none."""
    columns = list(columns)
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def in_list(column: Column, values: list, kind: T.DataType) -> Column:
    """False of an empty list."""
    return column.isin(*[lit(v, kind) for v in values]) if values else F.lit(False)


def resolve(table: TableDef, field: Field, of: str | None = None) -> tuple[Column, T.DataType, bool]:
    """The column of a field, its type, and whether it is JSON. Steps into JSON give text."""
    c = table.column(field.name)
    col = F.col(f"{of}.`{field.name}`" if of else f"`{field.name}`")
    if field.path:
        return jsonpath.extract(col, field.path), T.StringType(), field.path[-1][0] == "->"
    return col, c.type, c.json


def pattern(text: str) -> str:
    """`*` is a wildcard as % is; % and _ stay active."""
    return text.replace("*", "%")


def _compare(op: str, col: Column, kind: T.DataType, value, is_json: bool) -> Column:
    if op in COMPARISONS:
        return COMPARISONS[op](col, lit(value, kind))
    if op == "like":
        return col.like(pattern(str(value)))
    if op == "ilike":
        return col.ilike(pattern(str(value)))
    if op == "match":
        return col.rlike(str(value))
    if op == "imatch":
        return col.rlike("(?i)" + str(value))
    if op == "isdistinct":
        return ~col.eqNullSafe(lit(value, kind))
    if op == "startswith":
        return col.like(f"{value}%")
    if op == "endswith":
        return col.like(f"%{value}")
    if op == "contains":
        return col.like(f"%{value}%")
    raise bad_request(f"unknown operator {op}")


def _sets(op: str, col: Column, kind: T.DataType, value, is_json: bool) -> Column:
    """cs cd ov on arrays, ranges and JSON; sl sr nxr nxl adj on ranges."""
    if ranges.is_range(kind):
        return ranges.PREDICATES[op](col, lit(value, kind), kind["lower"].dataType)
    if isinstance(kind, T.ArrayType) and op in ("cs", "cd", "ov"):
        other = lit(value, kind)
        if op == "cs":  # a null is contained in nothing
            return F.when(col.isNull(), None).otherwise(F.forall(other, lambda x: F.coalesce(F.array_contains(F.array_compact(col), x), F.lit(False))))
        if op == "cd":
            return F.when(col.isNull(), None).otherwise(F.forall(col, lambda x: F.coalesce(F.array_contains(F.array_compact(other), x), F.lit(False))))
        return F.arrays_overlap(F.array_compact(col), F.array_compact(other))
    if is_json and op in ("cs", "cd"):
        try:
            v = json.loads(value) if isinstance(value, str) else value
        except ValueError:
            raise bad_request(f"not JSON: {value!r}") from None
        return jsonpath.contains(col, v) if op == "cs" else jsonpath.contained(col, v)
    raise bad_request(f"operator {op} does not apply to type {kind.simpleString()}")


def predicate(table: TableDef, f: Filter, of: str | None = None) -> Column:
    col, kind, is_json = resolve(table, f.field, of)
    op = f.op
    if op == "is":
        tests = {"null": col.isNull(), "not_null": col.isNotNull()}
        if f.value in ("true", "false", "unknown"):
            if not isinstance(kind, T.BooleanType):
                raise bad_request(f"is {f.value} needs a boolean column, and {f.field.name} is {kind.simpleString()}")
            tests |= {"true": col.eqNullSafe(F.lit(True)), "false": col.eqNullSafe(F.lit(False)), "unknown": col.isNull()}
        out = tests[f.value]
    elif op == "in":
        out = in_list(col, list(f.value), kind)
    elif op in fts.OPERATORS:
        out = fts.search(op, col.cast("string"), str(f.value), f.language)
    elif op in ("cs", "cd", "ov", "sl", "sr", "nxr", "nxl", "adj"):
        out = _sets(op, col, kind, f.value, is_json)
    elif f.quantifier:
        items = f.value if isinstance(f.value, list) else array_items(f.value)
        parts = [_compare(op, col, kind, v, is_json) for v in items]
        out = or_all(parts) if f.quantifier == "any" else and_all(parts)
    else:
        out = _compare(op, col, kind, f.value, is_json)
    return ~out if f.negated else out


def condition(table: TableDef, tree: Tree, of: str | None = None) -> Column:
    if isinstance(tree, Logic):
        parts = [condition(table, t, of) for t in tree.children]
        out = and_all(parts) if tree.op == "and" else or_all(parts)
        return ~out if tree.negated else out
    return predicate(table, tree, of)


def conditions(table: TableDef, trees: Iterable[Tree], of: str | None = None) -> Column | None:
    trees = list(trees)
    return and_all(condition(table, t, of) for t in trees) if trees else None
