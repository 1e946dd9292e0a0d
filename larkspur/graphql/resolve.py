"""GraphQL operations to the same reads and mutations as REST requests.

A root field is one read, embeds and all; only the fields asked for are projected.
"""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import render
from larkspur.catalog import Context, TableDef
from larkspur.errors import ApiError, bad_request, unknown_column
from larkspur.graphql.introspect import introspect
from larkspur.graphql.parser import FieldNode, parse
from larkspur.graphql.schema import Schema, build, scalar
from larkspur.operators.read import read_frame
from larkspur.plans.grammar import parse_order
from larkspur.plans.ir import Below, Embed, Field, Filter, Item, Logic, Order, Pick, Read, Tree
from larkspur.plans.request import Prefer
from larkspur.sources.payload import Payload

if TYPE_CHECKING:
    from larkspur.engine import Engine

OPS = {"eq": "eq", "neq": "neq", "gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte", "like": "like", "ilike": "ilike", "startsWith": "startswith", "endsWith": "endswith", "contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}


def filter_tree(table: TableDef, spec: Any) -> Tree | None:
    """{column: {op: value}}, {column: value}, and _and, _or, _not with or without the underscore. An unknown operator is an error."""
    if spec is None:
        return None
    if not isinstance(spec, dict):
        raise bad_request("a filter is an object")
    parts: list[Tree] = []
    for key, cond in spec.items():
        word = key.removeprefix("_")
        if word in ("and", "or") and not table.has(key):
            kids = [filter_tree(table, c) for c in (cond if isinstance(cond, list) else [cond])]
            parts.append(Logic(word, tuple(k for k in kids if k is not None)))
        elif word == "not" and not table.has(key):
            kid = filter_tree(table, cond)
            if kid is not None:
                parts.append(replace(kid, negated=not kid.negated))
        else:
            table.column(key)
            field = Field(key)
            if not isinstance(cond, dict):
                parts.append(Filter(field, "is", "null") if cond is None else Filter(field, "eq", cond))
                continue
            for op, value in cond.items():
                name = op.removeprefix("_")
                if name in ("isNull", "is_null"):
                    parts.append(Filter(field, "is", "null", negated=not value))
                elif name in ("in", "notIn", "not_in"):
                    if not isinstance(value, list):
                        raise bad_request(f"{op} takes a list")
                    parts.append(Filter(field, "in", value, negated=name != "in"))
                elif name in OPS:
                    if name == "neq" and value is None or name == "eq" and value is None:
                        parts.append(Filter(field, "is", "null", negated=name == "neq"))
                    else:
                        parts.append(Filter(field, OPS[name], value))
                else:
                    raise bad_request(f"unknown filter operator {op} on {key}")
    return Logic("and", tuple(parts)) if parts else None


#: What each kind of filter input takes.
TYPED = {
    "String": frozenset("eq neq like ilike in isNull startsWith endsWith contains".split()),
    "Int": frozenset("eq neq gt gte lt lte in isNull".split()),
    "Float": frozenset("eq neq gt gte lt lte isNull".split()),
    "Boolean": frozenset("eq isNull".split()),
    "UUID": frozenset("eq neq in isNull".split()),
}
_INPUT = {"Int": "Int", "BigInt": "Int", "Float": "Float", "BigDecimal": "Float", "Boolean": "Boolean"}


def typed_filter(table: TableDef, column: str, spec: dict[str, Any], kind: str | None = None) -> Tree | None:
    """Conditions on one column by the filter input of its type (or of `kind`); what the input does not have is an error. eq of a Boolean is IS TRUE or IS FALSE, so null is neither."""
    c = table.column(column)
    kind = kind or _INPUT.get(scalar(c.type, c.json), "String")
    for op in spec:
        if op not in TYPED[kind]:
            raise bad_request(f"{kind}FilterInput has no {op}")
    if kind == "Boolean" and "eq" in spec:
        parts: list[Tree] = [Filter(Field(column), "is", str(bool(spec["eq"])).lower())]
        rest = filter_tree(table, {column: {k: v for k, v in spec.items() if k != "eq"}}) if len(spec) > 1 else None
        return Logic("and", tuple(parts + ([rest] if rest else [])))
    return filter_tree(table, {column: spec})


def known_columns(table: TableDef, columns: list[str]) -> list[str]:
    """The columns that the table has; others are left out. Documents don't use this: there an unknown field is an error."""
    return [c for c in columns if table.has(c)]


def order_terms(table: TableDef, spec: Any) -> tuple[Order, ...]:
    """"col.desc", "col_DESC", "col", or {col: "DESC"}; an unknown column or direction is an error."""
    out: list[Order] = []
    for item in spec if isinstance(spec, list) else [spec] if spec is not None else []:
        if isinstance(item, dict):
            pairs = [(c, str(d)) for c, d in item.items()]
        elif "." in str(item):
            head, *mods = str(item).split(".")
            if any(m.lower() not in ("asc", "desc", "nullsfirst", "nullslast") for m in mods):
                raise bad_request(f"unknown order {item!r}")
            table.column(head)
            out += parse_order(str(item))
            continue
        else:
            head, _, last = str(item).rpartition("_")
            pairs = [(head, last)] if last.lower() in ("asc", "desc") and table.has(head) else [(str(item), "asc")]
        for c, d in pairs:
            table.column(c)
            if d.lower() not in ("asc", "desc"):
                raise bad_request(f"unknown order direction {d!r}")
            out.append(Order(Field(c), d.lower() == "desc"))
    return tuple(out)


def _whole(v: Any, what: str) -> int | None:
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, int) or v < 0:
        raise bad_request(f"{what} takes a whole number")
    return v


def _selection(schema: Schema, type_name: str, table: TableDef, fields: list[FieldNode], path: tuple[str, ...], below: dict[tuple[str, ...], Below]) -> tuple[Item, ...]:
    names = {t.name: n for n, t in schema.types.items()}
    items: list[Item] = []
    for f in fields:
        if f.name == "__typename":
            continue
        if table.has(f.name):
            items.append(Pick(Field(f.name), None, f.alias))
            continue
        rel = schema.relations[type_name].get(f.name)
        if rel is None:
            raise unknown_column(table.name.name, f.name)
        target = names[rel.target]
        at = (*path, f.key)
        tree = filter_tree(schema.types[target], f.args.get("filter") or f.args.get("where"))
        below[at] = Below((tree,) if tree else (), order_terms(schema.types[target], f.args.get("orderBy")), _whole(f.args.get("limit"), "limit"), _whole(f.args.get("offset"), "offset") or 0)
        inner = _selection(schema, target, schema.types[target], f.fields, at, below)
        if not inner:
            raise bad_request(f"{f.name} needs fields")
        items.append(Embed(rel.target.name, inner, f.key, rel.constraint))
    return tuple(items)


def _read(schema: Schema, table: TableDef, f: FieldNode, by_pk: bool) -> Read:
    type_name = next(n for n, t in schema.types.items() if t.name == table.name)
    below: dict[tuple[str, ...], Below] = {}
    items = _selection(schema, type_name, table, f.fields, (), below)
    if not items:
        items = tuple(Pick(Field(c)) for c in table.pk) or (Pick(Field(table.columns[0].name)),)
    if by_pk:
        where: tuple[Tree, ...] = tuple(_by_pk(table, f.args))
        return Read(table.name.name, table.name.schema, items, where, limit=1, below=below)
    tree = filter_tree(table, f.args.get("filter") or f.args.get("where"))
    return Read(table.name.name, table.name.schema, items, (tree,) if tree else (), (), order_terms(table, f.args.get("orderBy")), _whole(f.args.get("limit"), "limit"), _whole(f.args.get("offset"), "offset") or 0, below=below)


def _by_pk(table: TableDef, args: dict) -> list[Filter]:
    missing = [c for c in table.pk if args.get(c) is None]
    if missing:
        raise bad_request(f"key columns are missing: {', '.join(missing)}")
    return [Filter(Field(c), "eq", args[c]) for c in table.pk]


def root_frame(engine: "Engine", document: str, variables: dict[str, Any], ctx: Context | None = None) -> DataFrame:
    """The DataFrame of a query document with one root field."""
    kind, fields = parse(document, variables)
    if kind != "query" or len(fields) != 1:
        raise bad_request("one root field of a query is needed")
    schema = schema_of(engine)
    root = schema.queries.get(fields[0].name)
    if root is None:
        raise bad_request(f"no query field {fields[0].name}")
    return read_frame(engine.plan(ctx), _read(schema, root.table, fields[0], root.kind == "by_pk"))


def schema_of(engine: "Engine") -> Schema:
    return build(engine.catalog, engine.list_prefix, engine.list_suffix)


def subscription(engine: "Engine", document: str, variables: dict[str, Any], ctx: Context, folder: str) -> DataFrame:
    """The stream of a subscription with one root field: the changed rows of a base table under its filter and the role's policy, the selected columns and the operation."""
    from larkspur.operators.predicates import conditions
    from larkspur.operators.security import permitted
    from larkspur.streaming.changes import table_stream

    kind, fields = parse(document, variables)
    if kind != "subscription" or len(fields) != 1:
        raise bad_request("one root field of a subscription is needed")
    f = fields[0]
    name = schema_of(engine).subscriptions().get(f.name)
    if name is None:
        raise bad_request(f"no subscription field {f.name}")
    table = engine.catalog.tables[name]
    permitted(engine.catalog, name, ctx, "select")
    tree = filter_tree(table, f.args.get("filter") or f.args.get("where"))
    df = table_stream(engine.spark, engine.catalog, table, folder, conditions(table, (tree,)) if tree else None, ctx)
    picks = [x for x in f.fields if x.name != "__typename"]
    return df.select("operation", *[F.col(f"`{table.column(x.name).name}`").alias(x.key) for x in picks])


def execute(engine: "Engine", document: str, variables: dict[str, Any], ctx: Context, operation: str | None = None) -> dict:
    """{'data': ..., 'errors': [...]}: a field that fails is null, and the others stand."""
    try:
        kind, fields = parse(document, variables, operation)
        schema = schema_of(engine)
    except ApiError as e:
        return {"data": None, "errors": [e.to_dict(engine.debug)]}
    if kind == "subscription":
        return {"data": None, "errors": [bad_request("a subscription is a stream: ask Engine.subscribe for it").to_dict()]}
    data: dict[str, Any] = {}
    errors: list[dict] = []
    for f in fields:
        try:
            if f.name == "__typename":
                data[f.key] = kind.capitalize()
            elif f.name in ("__schema", "__type"):
                data[f.key] = introspect(schema, f)
            else:
                data[f.key] = _query(engine, schema, f, ctx) if kind == "query" else _mutation(engine, schema, f, ctx)
        except Exception as e:
            from larkspur.errors import from_spark

            err = e if isinstance(e, ApiError) else from_spark(e)
            data[f.key] = None
            errors.append(err.to_dict(engine.debug) | {"path": [f.key]})
    return {"data": data} | ({"errors": errors} if errors else {})


def _rows(engine: "Engine", table: TableDef, df: DataFrame, fields: list[FieldNode]) -> list[dict]:
    json_columns = frozenset(f.key for f in fields if table.has(f.name) and table.column(f.name).json)
    return render.rows(df, json_columns)


def _query(engine: "Engine", schema: Schema, f: FieldNode, ctx: Context) -> Any:
    root = schema.queries.get(f.name)
    if root is None:
        raise bad_request(f"no query field {f.name}")
    df = read_frame(engine.plan(ctx), _read(schema, root.table, f, root.kind == "by_pk"))
    found = _rows(engine, root.table, df, f.fields)
    return (found[0] if found else None) if root.kind == "by_pk" else found


def _mutation(engine: "Engine", schema: Schema, f: FieldNode, ctx: Context) -> Any:
    root = schema.mutations.get(f.name)
    if root is None:
        raise bad_request(f"no mutation field {f.name}")
    t, a = root.table, f.args
    verb = root.kind.split("_")[0]
    where: tuple[Tree, ...] = ()
    payload, prefer = Payload(), Prefer()
    if verb == "insert":
        objects = a.get("objects", a.get("object"))
        objects = objects if isinstance(objects, list) else [objects] if objects is not None else []
        if not objects or not all(isinstance(o, dict) for o in objects):
            raise bad_request("objects must be one object or more")
        payload = Payload(tuple(objects), tuple(dict.fromkeys(k for o in objects for k in o)), None, True)
        conflict = a.get("onConflict") or a.get("on_conflict")
        prefer = Prefer(missing="default", resolution=None if not conflict else "merge-duplicates" if conflict.get("update_columns", conflict.get("updateColumns")) != [] else "ignore-duplicates")
    else:
        if root.kind.endswith("by_pk"):
            where = tuple(_by_pk(t, a))
        else:
            tree = filter_tree(t, a.get("where"))
            if tree is None:
                raise bad_request(f"{f.name} needs a where condition")
            where = (tree,)
        if verb == "update":
            row = a.get("set") or a.get("_set")
            if not row:
                raise bad_request(f"{f.name} has nothing to set")
            payload = Payload((row,), tuple(row))
    affected = engine.apply(verb, t, where, payload, ctx, prefer)
    read = _read(schema, t, FieldNode(f.name, None, {}, f.fields), False)
    plan = replace(engine.plan(ctx), source=lambda x: affected if x.name == t.name else engine.store.written(x), most=None)
    found = _rows(engine, t, read_frame(plan, read), f.fields)
    return found if root.kind in ("insert", "update", "delete") else (found[0] if found else None)
