"""Routines: choosing an overload by argument names, binding typed arguments, shaping results."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.catalog import Catalog, Name, Param, Routine
from larkspur.errors import ApiError, bad_request
from larkspur.functions.types import value_of

_HINTS: dict[Any, T.DataType] = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), list[float]: T.ArrayType(T.DoubleType()), list[int]: T.ArrayType(T.LongType()), list[str]: T.ArrayType(T.StringType())}


def routine(name: str, call: Callable, returns: str = "setof", volatility: str = "stable", schema: str = "public", composite: bool = True) -> Routine:
    """A Python callable (spark, **args) with its parameters read from its signature."""
    hints = get_type_hints(call)
    params = []
    for p in list(inspect.signature(call).parameters.values())[1:]:
        required = p.default is inspect.Parameter.empty and p.kind is not inspect.Parameter.VAR_POSITIONAL
        params.append(Param(p.name, _HINTS.get(hints.get(p.name), T.StringType()), required, None if required else p.default, p.kind is inspect.Parameter.VAR_POSITIONAL))
    return Routine(Name(schema, name), call, tuple(params), returns, composite, volatility, inspect.getdoc(call))


def with_routines(catalog: Catalog, *routines: Routine) -> Catalog:
    return replace(catalog, routines=catalog.routines + routines)


def choose(overloads: list[Routine], names: set[str]) -> Routine:
    """The overload that takes all these arguments and needs no other; the one with fewest defaults left over first."""
    fit = [r for r in overloads if names <= {p.name for p in r.params} and {p.name for p in r.params if p.required} <= names]
    if not fit:
        r = overloads[0]
        raise ApiError("not_found", "no_overload", f"no function {r.name.name} takes ({', '.join(sorted(names))})", hint="; ".join("(" + ", ".join(p.name + ("" if p.required else "?") for p in r.params) + ")" for r in overloads))
    return min(fit, key=lambda r: len(r.params) - len(names))


def bind(overloads: list[Routine], named: dict[str, Any] | None = None, single: Any = None, positional: tuple = ()) -> tuple[Routine, dict[str, Any]]:
    """Arguments by name, by position, or one value for a function of one parameter."""
    if positional:
        for r in overloads:
            if sum(p.required for p in r.params) <= len(positional) <= len(r.params):
                return r, {p.name: value_of(v, p.type) for p, v in zip(r.params, positional, strict=False)}
        raise bad_request(f"no function {overloads[0].name.name} takes {len(positional)} arguments")
    if named is None and single is not None:
        for r in overloads:
            if len(r.params) >= 1 and all(not p.required for p in r.params[1:]):
                return r, {r.params[0].name: value_of(single, r.params[0].type) if not isinstance(single, (bytes, dict)) else single}
        raise bad_request(f"no function {overloads[0].name.name} takes a single value")
    named = named or {}
    r = choose(overloads, set(named))
    types = {p.name: p.type for p in r.params}
    return r, {k: value_of(v, types[k]) for k, v in named.items()}


def call(spark: SparkSession, r: Routine, args: dict[str, Any], read_only: bool = False) -> DataFrame | Any:
    """A volatile function is refused where the request may only read."""
    if read_only and not r.safe:
        raise ApiError("method_not_allowed", "volatile_function", f"{r.name.name} may change data: call it by POST")
    return r.call(spark, **args)


def shape(rows: list[dict], r: Routine, compat: bool = False) -> Any:
    """Rows as the caller sees them. compat un-nests a lone column named as the function, and gives a bare value unless set-returning."""
    if not compat:
        return rows
    if not r.composite and rows and all(list(x) == [r.name.name] for x in rows):
        rows = [x[r.name.name] for x in rows]
    if r.returns == "setof":
        return rows
    if r.returns == "void":
        return None
    return rows[0] if len(rows) == 1 else (None if not rows else rows)
