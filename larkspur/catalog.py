"""What the engine knows of tables: columns, keys, relationships, routines, policies.

A Catalog is a value; `Handle` holds the current one and swaps it when reloaded. Spark tables
have no keys, so keys and relationships are declared; columns come from the schemas.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.errors import ApiError, unknown_column, unknown_relationship, unknown_table
from larkspur.functions.types import name_of


class Name(NamedTuple):
    schema: str
    name: str

    def __str__(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    nullable: bool = True
    default: Any = None
    enum: tuple[str, ...] = ()
    is_pk: bool = False
    position: int = 1
    json: bool = False
    auto: bool = False
    max_length: int | None = None

    @property
    def has_default(self) -> bool:
        return self.default is not None or self.auto


@dataclass(frozen=True)
class TableDef:
    name: Name
    load: Callable[[SparkSession], DataFrame]
    columns: tuple[ColumnDef, ...]
    pk: tuple[str, ...] = ()
    is_view: bool = False
    insertable: bool = True
    updatable: bool = True
    deletable: bool = True
    description: str | None = None

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise unknown_column(str(self.name), name)

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)


@dataclass(frozen=True)
class Relationship:
    """From table to target by pairs of columns. kind: m2o, o2m, o2o, m2m (through a junction) or computed."""

    table: Name
    target: Name
    columns: tuple[tuple[str, str], ...]
    kind: str
    constraint: str
    junction: Name | None = None
    junction_columns: tuple[tuple[str, str], ...] = ()
    compute: Callable[[DataFrame], DataFrame] | None = None

    @property
    def to_many(self) -> bool:
        return self.kind in ("o2m", "m2m")


@dataclass(frozen=True)
class Param:
    name: str
    type: T.DataType = T.StringType()
    required: bool = True
    default: Any = None
    variadic: bool = False


@dataclass(frozen=True)
class Routine:
    """returns: scalar, setof, table or void. call takes (spark, **args)."""

    name: Name
    call: Callable[..., Any]
    params: tuple[Param, ...] = ()
    returns: str = "setof"
    composite: bool = True
    volatility: str = "volatile"
    description: str | None = None

    @property
    def safe(self) -> bool:
        return self.volatility in ("stable", "immutable")


@dataclass(frozen=True)
class Policy:
    """Rows of a table that roles may touch by a command. Several policies of one command are alternatives.

    check holds for rows as they are written; where it is not given, using does.
    """

    table: Name
    roles: tuple[str, ...]
    command: str
    using: Callable[["Context"], Column]
    check: Callable[["Context"], Column] | None = None


@dataclass(frozen=True)
class Context:
    """Who asks. claims are those of a verified token."""

    role: str = "anon"
    claims: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    tables: dict[Name, TableDef]
    relationships: tuple[Relationship, ...] = ()
    routines: tuple[Routine, ...] = ()
    policies: tuple[Policy, ...] = ()
    grants: dict[tuple[str, Name], frozenset[str]] | None = None
    schemas: tuple[str, ...] = ("public",)
    version: str = ""

    def table(self, name: str, schema: str | None = None) -> TableDef:
        key = Name(schema or self.schemas[0], name)
        if key not in self.tables or key.schema not in self.schemas:
            raise unknown_table(str(key))
        return self.tables[key]

    def schema(self, asked: str | None) -> str:
        """The asked schema if it is exposed, the first one by default."""
        if asked is None:
            return self.schemas[0]
        if asked not in self.schemas:
            raise ApiError("not_acceptable", "schema_not_exposed", f"Schema {asked} is not among: {', '.join(self.schemas)}")
        return asked

    def relationship(self, table: Name, to: str, hint: str | None = None) -> Relationship:
        """By the target's name, or the constraint's; a hint is a constraint, a column or a junction."""
        found = [r for r in self.relationships if r.table == table and (r.target.name == to or r.constraint == to)]
        if hint:
            found = [r for r in found if hint in (r.constraint, r.junction and r.junction.name) or any(hint in pair for pair in r.columns)]
        if not found:
            raise unknown_relationship(str(table), to + (f"!{hint}" if hint else ""))
        if len(found) > 1 and not hint:
            direct = [r for r in found if r.kind != "m2m"]
            if len(direct) != 1:
                raise ApiError("bad_request", "ambiguous_relationship", f"{table} and {to} are related in {len(found)} ways", hint="name one: " + ", ".join(sorted(r.constraint for r in found)))
            found = direct
        if found[0].target.schema not in self.schemas:
            raise unknown_relationship(str(table), to)
        return found[0]

    def overloads(self, name: str, schema: str | None = None) -> list[Routine]:
        key = Name(schema or self.schemas[0], name)
        found = [r for r in self.routines if r.name == key]
        if not found:
            raise ApiError("not_found", "function_not_found", f"No function {key} is exposed")
        return found

    def timezones(self) -> set[str]:
        return zoneinfo.available_timezones()


class Handle:
    """The current catalog of an engine; reload swaps it whole."""

    def __init__(self, load: Callable[[], Catalog]):
        self._load = load
        self.current = load()

    def reload(self) -> Catalog:
        self.current = self._load()
        return self.current


def table_of(df: DataFrame, name: str, pk: Iterable[str] = (), schema: str = "public", load: Callable[[SparkSession], DataFrame] | None = None, json: Iterable[str] = (), defaults: dict[str, Any] | None = None, required: Iterable[str] = (), auto: Iterable[str] = (), enums: dict[str, tuple[str, ...]] | None = None, **flags) -> TableDef:
    """A table with the columns of df; df itself is scanned unless `load` says how."""
    pk, json, defaults, required, auto = tuple(pk), set(json), defaults or {}, set(required), set(auto)
    cols = tuple(
        ColumnDef(f.name, f.dataType, f.nullable and f.name not in required and f.name not in pk, defaults.get(f.name), (enums or {}).get(f.name, ()), f.name in pk, i, f.name in json, f.name in auto)
        for i, f in enumerate(df.schema.fields, 1)
    )
    return TableDef(Name(schema, name), load or (lambda spark: df), cols, pk, **flags)


def foreign_key(constraint: str, table: str, columns: Iterable[str], target: str, target_columns: Iterable[str], unique: bool = False, schema: str = "public") -> list[Relationship]:
    """Both directions of a foreign key; unique: the referring columns are a key, so that both sides have one row."""
    pairs = tuple(zip(columns, target_columns, strict=True))
    a, b = Name(schema, table), Name(schema, target)
    back = tuple((y, x) for x, y in pairs)
    return [Relationship(a, b, pairs, "o2o" if unique else "m2o", constraint), Relationship(b, a, back, "o2o" if unique else "o2m", constraint)]


def many_to_many(junction: str, left: tuple[str, str, str], right: tuple[str, str, str], schema: str = "public") -> list[Relationship]:
    """Through a junction; each side is (table, its column, the junction's column)."""
    j = Name(schema, junction)
    (a, ac, aj), (b, bc, bj) = left, right
    make = lambda t, tc, tj, u, uc, uj: Relationship(Name(schema, t), Name(schema, u), ((tc, tj),), "m2m", f"{junction}_{t}_{u}", j, ((uj, uc),))
    return [make(a, ac, aj, b, bc, bj), make(b, bc, bj, a, ac, aj)]


def describe(catalog: Catalog) -> list[dict]:
    """A row a column, as an information schema would list it."""
    return [
        {"schema": t.name.schema, "table": t.name.name, "is_view": t.is_view, "column": c.name, "type": name_of(c.type), "nullable": c.nullable, "is_pk": c.is_pk, "position": c.position}
        for t in catalog.tables.values()
        for c in t.columns
    ]
