"""The GraphQL schema of a catalog: fields by name, and the schema's text.

Each exposed table has a list field, a field by primary key, six mutations where it may be
written, and a relationship field for each exposed relation. Tables of other schemas than the
first carry their schema's name; names that would collide get a number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from larkspur.catalog import Catalog, ColumnDef, Name, Relationship, TableDef
from larkspur.functions.names import camel, pascal, plural, singular

_SCALARS = {"smallint": "Int", "int": "Int", "bigint": "BigInt", "float": "Float", "double": "Float", "boolean": "Boolean", "date": "Date", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "binary": "String"}


def scalar(kind: T.DataType, json: bool = False) -> str:
    if json or isinstance(kind, (T.StructType, T.MapType)):
        return "JSON"
    if isinstance(kind, T.ArrayType):
        return f"[{scalar(kind.elementType)}]"
    if isinstance(kind, T.DecimalType):
        return "BigDecimal"
    return _SCALARS.get(kind.simpleString(), "String")


def column_type(c: ColumnDef) -> str:
    return scalar(c.type, c.json) + ("" if c.nullable and not c.is_pk else "!")


@dataclass(frozen=True)
class Root:
    """kind: list, by_pk, insert, insert_one, update, update_by_pk, delete, delete_by_pk."""

    kind: str
    table: TableDef


@dataclass(frozen=True)
class Schema:
    queries: dict[str, Root]
    mutations: dict[str, Root]
    relations: dict[str, dict[str, Relationship]]
    types: dict[str, TableDef]

    def text(self) -> str:
        """The schema in its own language, in a stable order."""
        out = ["scalar BigInt", "scalar BigDecimal", "scalar JSON", "scalar Date", "scalar DateTime", ""]
        names = {t.name: n for n, t in self.types.items()}
        for name, t in sorted(self.types.items()):
            out.append(f"type {name} {{")
            out += [f"  {c.name}: {column_type(c)}" for c in t.columns]
            for f, r in sorted(self.relations[name].items()):
                other = names[r.target]
                out.append(f"  {f}{'(filter: JSON, orderBy: [String!], limit: Int, offset: Int)' if r.to_many else ''}: {f'[{other}!]!' if r.to_many else other}")
            out += ["}", ""]
        for head, fields in (("Query", self.queries), ("Mutation", self.mutations)):
            if fields:
                out.append(f"type {head} {{")
                for f, r in sorted(fields.items()):
                    pk = ", ".join(f"{c.name}: {scalar(c.type)}!" for c in r.table.columns if c.is_pk)
                    args = {"list": "filter: JSON, orderBy: [String!], limit: Int, offset: Int", "by_pk": pk, "insert": "objects: [JSON!]!", "insert_one": "objects: JSON!", "update": "where: JSON!, set: JSON!", "update_by_pk": f"{pk}, set: JSON!", "delete": "where: JSON!", "delete_by_pk": pk}[r.kind]
                    one = r.kind in ("by_pk", "insert_one", "update_by_pk", "delete_by_pk")
                    out.append(f"  {f}({args}): {names[r.table.name] if one else f'[{names[r.table.name]}!]!'}")
                out += ["}", ""]
        out += ["type Subscription {", *(f"  {f}: {names[n]}" for f, n in sorted(self.subscriptions().items())), "}", ""]
        return "\n".join(out)

    def subscriptions(self) -> dict[str, Name]:
        """A field for each base table."""
        out: dict[str, Name] = {}
        for t in self.types.values():  # those of the first schema come first
            if not t.is_view:
                name = camel(t.name.name)
                out[name if name not in out else camel(f"{t.name.schema}_{t.name.name}")] = t.name
        return out


def build(catalog: Catalog, prefix: str = "", suffix: str = "") -> Schema:
    """prefix and suffix go around the names of list fields."""
    queries: dict[str, Root] = {}
    mutations: dict[str, Root] = {}
    types: dict[str, TableDef] = {}

    def free(name: str, taken: dict) -> str:
        n, i = name, 2
        while n in taken:
            n, i = f"{name}{i}", i + 1
        return n

    for t in sorted(catalog.tables.values(), key=lambda t: (catalog.schemas.index(t.name.schema) if t.name.schema in catalog.schemas else 99, t.name.name)):
        if t.name.schema not in catalog.schemas:
            continue
        base = t.name.name if t.name.schema == catalog.schemas[0] else f"{t.name.schema}_{t.name.name}"
        types[free(pascal(singular(base)), types)] = t
        one, many = camel(singular(base)), camel(base)
        many = (prefix + many[:1].upper() + many[1:] if prefix else many) + suffix
        queries[free(many, queries)] = Root("list", t)
        if t.pk:
            queries[free(f"{one}ByPk", queries)] = Root("by_pk", t)
        up, ups = pascal(singular(base)), pascal(base)
        for kind, name, allowed in (
            ("insert", f"insert{ups}", t.insertable), ("insert_one", f"insert{up}One", t.insertable), ("update", f"update{ups}", t.updatable),
            ("update_by_pk", f"update{up}ByPk", t.updatable and t.pk), ("delete", f"delete{ups}", t.deletable), ("delete_by_pk", f"delete{up}ByPk", t.deletable and t.pk),
        ):
            if allowed and not t.is_view:
                mutations[free(name, mutations)] = Root(kind, t)
    exposed = {t.name for t in types.values()}
    relations: dict[str, dict[str, Relationship]] = {}
    for name, t in types.items():
        fields: dict[str, Relationship] = {}
        for r in catalog.relationships:
            if r.table == t.name and r.target in exposed:
                want = plural(singular(r.target.name)) if r.to_many else singular(r.target.name)
                fields[free(want if not t.has(want) else f"{want}_rel", fields)] = r
        relations[name] = fields
    return Schema(queries, mutations, relations, types)
