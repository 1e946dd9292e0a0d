"""Introspection: __schema and __type as the GraphQL specification has them."""

from __future__ import annotations

from typing import Any

from larkspur.catalog import TableDef
from larkspur.graphql.parser import FieldNode
from larkspur.graphql.schema import Root, Schema, column_type, scalar

SCALARS = ("String", "Int", "Float", "Boolean", "ID", "BigInt", "BigDecimal", "JSON", "Date", "DateTime")


def _ref(text: str, types: dict[str, dict]) -> dict:
    """A type in the schema's language as a reference: T!, [T], T."""
    if text.endswith("!"):
        return {"kind": "NON_NULL", "name": None, "ofType": _ref(text[:-1], types)}
    if text.startswith("["):
        return {"kind": "LIST", "name": None, "ofType": _ref(text[1:-1], types)}
    return types[text]


def _named(kind: str, name: str, description: str | None = None) -> dict:
    blank = {"fields": None, "inputFields": None, "interfaces": None, "enumValues": None, "possibleTypes": None, "ofType": None, "specifiedByURL": None, "isOneOf": None}
    return {"__typename": "__Type", "kind": kind, "name": name, "description": description} | blank


def model(schema: Schema) -> dict[str, Any]:
    """The schema as introspection's own objects."""
    types = {n: _named("SCALAR", n) for n in SCALARS}
    names = {t.name: n for n, t in schema.types.items()}
    for n, t in schema.types.items():
        types[n] = _named("OBJECT", n, t.description) | {"interfaces": []}
    for n in ("Query", "Mutation", "Subscription"):
        types[n] = _named("OBJECT", n) | {"interfaces": []}

    def arg(name: str, kind: str) -> dict:
        return {"__typename": "__InputValue", "name": name, "description": None, "type": _ref(kind, types), "defaultValue": None, "isDeprecated": False, "deprecationReason": None}

    def field(name: str, kind: str, args: list[tuple[str, str]] = ()) -> dict:  # type: ignore[assignment]
        return {"__typename": "__Field", "name": name, "description": None, "args": [arg(*a) for a in args], "type": _ref(kind, types), "isDeprecated": False, "deprecationReason": None}

    lists = [("filter", "JSON"), ("orderBy", "[String!]"), ("limit", "Int"), ("offset", "Int")]

    def root(name: str, r: Root) -> dict:
        t: TableDef = r.table
        pk = [(c.name, scalar(c.type) + "!") for c in t.columns if c.is_pk]
        args = {"list": lists, "by_pk": pk, "insert": [("objects", "[JSON!]!"), ("onConflict", "JSON")], "insert_one": [("objects", "JSON!"), ("onConflict", "JSON")], "update": [("where", "JSON!"), ("set", "JSON!")], "update_by_pk": [*pk, ("set", "JSON!")], "delete": [("where", "JSON!")], "delete_by_pk": pk}[r.kind]
        one = r.kind in ("by_pk", "insert_one", "update_by_pk", "delete_by_pk")
        return field(name, names[t.name] if one else f"[{names[t.name]}!]!", args)

    for n, t in schema.types.items():
        links = [field(f, f"[{names[r.target]}!]!" if r.to_many else names[r.target], lists if r.to_many else []) for f, r in sorted(schema.relations[n].items())]
        types[n]["fields"] = [field(c.name, column_type(c)) for c in t.columns] + links
    types["Query"]["fields"] = [root(f, r) for f, r in sorted(schema.queries.items())]
    types["Mutation"]["fields"] = [root(f, r) for f, r in sorted(schema.mutations.items())]
    types["Subscription"]["fields"] = [field(f, names[n], lists[:1]) for f, n in sorted(schema.subscriptions().items())]
    whole = [t for n, t in types.items() if n not in ("Mutation", "Subscription") or t["fields"]]
    directives = [{"__typename": "__Directive", "name": n, "description": None, "locations": ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"], "args": [arg("if", "Boolean!")], "isRepeatable": False} for n in ("include", "skip")]
    held = lambda n: types[n] if types[n]["fields"] else None
    return {"__typename": "__Schema", "description": None, "types": whole, "queryType": types["Query"], "mutationType": held("Mutation"), "subscriptionType": held("Subscription"), "directives": directives}


def _select(value: Any, fields: list[FieldNode]) -> Any:
    if isinstance(value, list):
        return [_select(v, fields) for v in value]
    if not isinstance(value, dict):
        return value
    return {f.key: _select(value.get(f.name), f.fields) for f in fields}


def introspect(schema: Schema, f: FieldNode) -> Any:
    """The answer to a __schema or __type field. `sdl` of __schema is the schema in its own language."""
    whole = model(schema)
    if f.name == "__type":
        found = next((t for t in whole["types"] if t["name"] == f.args.get("name")), None)
        return _select(found, f.fields)
    return _select(whole | {"sdl": schema.text()}, f.fields)
