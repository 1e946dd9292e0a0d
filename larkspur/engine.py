"""Requests to responses: one engine over a catalog, for REST-style calls and GraphQL documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import render
from larkspur.catalog import Catalog, ColumnDef, Context, Handle, TableDef
from larkspur.errors import ApiError, bad_request, from_spark
from larkspur.operators import mutate, routines
from larkspur.operators.read import Plan, count_rows, filtered, name_of, read_frame
from larkspur.operators.security import obey, permitted, visible
from larkspur.plans import grammar, request
from larkspur.plans.ir import Pick, Read, Tree
from larkspur.sources import payload as bodies


@dataclass
class Response:
    status: int
    body: Any = None
    headers: dict[str, str] = field(default_factory=dict)
    df: DataFrame | None = None

    def text(self) -> str:
        return self.body if isinstance(self.body, str) else render.dumps(self.body, self.headers.get("x-key-order", "sorted"))


class Engine:
    """max_rows caps every page and every list of children; key_order is 'sorted' or 'select'.

    before(engine, method, path, context) runs ahead of each request: it may give another
    context, or raise an ApiError. list_prefix and list_suffix go around the names of GraphQL
    list fields.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | Callable[[], Catalog], max_rows: int | None = None, folder: str | None = None, key_order: str = "sorted", rpc_compat: bool = False, debug: bool = True, before: Callable[["Engine", str, str, Context], Context | None] | None = None, list_prefix: str = "", list_suffix: str = ""):
        self.spark = spark
        self.handle = Handle(catalog if callable(catalog) else lambda: catalog)
        self.max_rows, self.key_order, self.rpc_compat, self.debug = max_rows, key_order, rpc_compat, debug
        self.before, self.list_prefix, self.list_suffix = before, list_prefix, list_suffix
        self.store = mutate.Store(spark, folder)

    @property
    def catalog(self) -> Catalog:
        return self.handle.current

    def plan(self, ctx: Context | None = None) -> Plan:
        return Plan(self.spark, self.catalog, ctx or Context(), self.max_rows, self.store.written)

    def frame(self, table: str, query: str = "", ctx: Context | None = None, schema: str | None = None) -> DataFrame:
        """The DataFrame of a read, unexecuted."""
        return read_frame(self.plan(ctx), grammar.parse_query(query, table, schema).read)

    def request(self, method: str, path: str, query: str = "", headers: dict[str, str] | None = None, body: bytes | str | None = None, ctx: Context | None = None) -> Response:
        """A response whatever happens: errors are rendered by their code."""
        try:
            ctx = ctx or Context()
            if self.before:
                ctx = self.before(self, method, path, ctx) or ctx
            return self._request(method, path, query, {k.lower(): v for k, v in (headers or {}).items()}, body, ctx)
        except ApiError as e:
            return Response(e.status, e.to_dict(self.debug))
        except PySparkException as e:
            err = from_spark(e)
            return Response(err.status, err.to_dict(self.debug))

    def _request(self, method: str, path: str, query: str, headers: dict[str, str], body, ctx: Context) -> Response:
        action = request.parse_action(method, path)
        schema = request.parse_schema(self.catalog.schemas, headers, action.read_only)
        prefer, media = request.parse_prefer(headers.get("prefer")), request.parse_accept(headers.get("accept"))
        extra = {"preference-applied": ", ".join(prefer.applied)} if prefer.applied else {}
        if action.kind == "root":
            return Response(200, [{"schema": t.name.schema, "name": t.name.name, "kind": "view" if t.is_view else "table"} for t in self.catalog.tables.values() if t.name.schema == schema], extra)
        if action.kind == "info":
            allow = "OPTIONS,GET,HEAD,POST"
            if "/rpc/" not in f"/{path.strip('/')}":
                t = self.catalog.table(action.resource, schema)
                allow = "OPTIONS,GET,HEAD" + (",POST" if t.insertable else "") + (",PUT" if t.insertable and t.updatable and t.pk else "") + (",PATCH" if t.updatable else "") + (",DELETE" if t.deletable else "")
            return Response(200, None, {"allow": allow} | extra)
        zone, old = prefer.timezone, self.spark.conf.get("spark.sql.session.timeZone")
        if zone:
            if zone not in self.catalog.timezones():
                raise bad_request(f"unknown time zone {zone}")
            self.spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            if action.kind == "call":
                return self._call(action, query, headers, body, ctx, schema, media, extra)
            if action.kind == "read":
                return self._read(action, query, headers, ctx, schema, prefer, media, extra)
            return self._mutate(action, query, headers, body, ctx, schema, prefer, media, extra)
        finally:
            if zone:
                self.spark.conf.set("spark.sql.session.timeZone", old)

    def _json_columns(self, table: TableDef, read: Read) -> frozenset[str]:
        names = {c.name for c in table.columns if c.json}
        picks = {name_of(i) for i in read.select if isinstance(i, Pick) and i.field.name in names and not i.field.path}
        return frozenset(names | picks)

    def _read(self, action, query, headers, ctx, schema, prefer, media, extra) -> Response:
        q = grammar.parse_query(query, action.resource, schema)
        read = request.resolve_range(q.read, request.parse_range(headers.get("range")), self.max_rows)
        plan = self.plan(ctx)
        total = count_rows(plan, read, prefer.count) if prefer.count else None
        if total is not None and read.offset > total > 0:
            raise ApiError("range", "range_not_satisfiable", f"offset {read.offset} of {total} rows")
        df = read_frame(plan, read)
        if media.kind == "plan":
            return Response(200, render.explain(df, "extended" if "verbose" in media.plan_options else "formatted"), extra, df)
        if action.headers_only:
            return Response(200, None, extra | {"content-range": f"*/{'*' if total is None else total}"}, df)
        table = self.catalog.table(action.resource, schema)
        found = render.rows(df.limit(2) if media.kind == "singular" else df, self._json_columns(table, read))
        head = extra | {"content-range": render.content_range(read.offset, len(found), total)}
        return self._render(found, media, head, render.status_of(len(found), total, read.limit is not None or bool(read.offset)), df)

    def _render(self, found: list[dict], media, headers: dict, status: int, df: DataFrame | None = None) -> Response:
        if media.strip_nulls:
            found = render.strip_nulls(found)
        headers = headers | {"x-key-order": self.key_order}
        if media.kind == "singular":
            return Response(status, render.singular(found, media.nullable), headers, df)
        if media.kind == "csv":
            ordered = [dict(sorted(r.items())) for r in found] if self.key_order == "sorted" else found
            return Response(status, render.to_csv(ordered), headers | {"content-type": "text/csv"}, df)
        if self.key_order == "sorted":
            found = [dict(sorted(r.items())) for r in found]
        return Response(status, found, headers, df)

    def _call(self, action, query, headers, body, ctx, schema, media, extra) -> Response:
        overloads = self.catalog.overloads(action.resource, schema)
        names = {p.name for r in overloads for p in r.params}
        q = grammar.parse_query(query, action.resource, schema, names)
        named: dict[str, Any] | None = {}
        single = None
        if not action.read_only and body:
            p = bodies.parse(body, headers.get("content-type", "application/json"))
            if p.raw is not None or p.is_array or headers.get("prefer", "").find("params=single-object") >= 0:
                single, named = p.raw if p.raw is not None else (list(p.rows) if p.is_array else p.rows[0]), None
            else:
                named = dict(p.rows[0]) if p.rows else {}
        else:
            for k, v in q.args:
                named[k if k in names else k.lstrip("_")] = v  # type: ignore[index]
        r, args = routines.bind(overloads, named, single)
        permitted(self.catalog, r.name, ctx, "execute")
        out = routines.call(self.spark, r, args, action.read_only)
        if isinstance(out, DataFrame):
            shape = TableDef(r.name, lambda s: out, _columns(out))
            plan = Plan(self.spark, replace(self.catalog, tables=self.catalog.tables | {r.name: shape}), ctx, self.max_rows)
            read = request.resolve_range(replace(q.read, table=r.name.name, schema=r.name.schema), request.parse_range(headers.get("range")), self.max_rows)
            df = read_frame(plan, read)
            found = render.rows(df)
        else:
            df, found = None, [] if r.returns == "void" else [{r.name.name: out}]
        if action.headers_only:
            return Response(200, None, extra, df)
        if self.rpc_compat:
            return Response(200, routines.shape(found, r, True), extra, df)
        return self._render(found, media, extra, 200, df)

    def _mutate(self, action, query, headers, body, ctx, schema, prefer, media, extra) -> Response:
        q = grammar.parse_query(query, action.resource, schema)
        table = self.catalog.table(action.resource, schema)
        p = bodies.parse(body, headers.get("content-type", "application/json")) if action.kind != "delete" else bodies.Payload()
        affected = self.apply(action.kind, table, q.read.where, p, ctx, prefer, q.on_conflict, q.columns)
        if prefer.representation != "representation":
            n = f"*/{affected.count()}" if prefer.count else "*/*"
            return Response(201 if action.kind == "insert" else 204, None, extra | {"content-range": n})
        permitted(self.catalog, table.name, ctx, "select")
        out = visible(self.catalog, table.name, ctx, affected)
        if q.read.select:
            plan = replace(self.plan(ctx), source=lambda t: affected if t.name == table.name else self.store.written(t))
            out = read_frame(plan, Read(table.name.name, table.name.schema, q.read.select))
        found = render.rows(out, self._json_columns(table, q.read))
        head = extra | {"content-range": render.content_range(0, len(found), len(found) if prefer.count else None)}
        return self._render(found, media, head, 201 if action.kind == "insert" else 200)

    def apply(self, kind: str, table: TableDef, where: tuple[Tree, ...], p: bodies.Payload, ctx: Context, prefer=None, on_conflict: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
        """Makes one mutation and commits it; the affected rows come back, unexecuted."""
        prefer = prefer or request.Prefer()
        command = {"insert": "insert", "upsert": "insert", "update": "update", "delete": "delete"}[kind]
        merges = kind == "upsert" or (kind == "insert" and prefer.resolution != "ignore-duplicates" and (prefer.resolution == "merge-duplicates" or bool(on_conflict)))
        for c in (command, "update") if merges else (command,):
            if not {"insert": table.insertable, "update": table.updatable, "delete": table.deletable}[c]:
                raise ApiError("method_not_allowed", "not_writable", f"{table.name.name} does not take {c}")
            permitted(self.catalog, table.name, ctx, c)
        with self.store.lock:
            current = self.store.rows(table)
            if kind in ("insert", "upsert"):
                if not p.rows:
                    raise bad_request("there are no rows to insert")
                rows = bodies.frame(self.spark, table, p, columns, prefer.missing or "null")
                rows = self._with_auto(table, current, rows)
                obey(self.catalog, table.name, ctx, "insert", rows)
                keys = on_conflict or table.pk
                if merges and (table.pk if kind == "upsert" else keys):
                    at = list(table.pk if kind == "upsert" else keys)
                    hit = current.join(rows.select(*at), at, "left_semi")
                    for c in ("update", "select"):  # a row that the role may not change, or not see, is not merged into
                        obey(self.catalog, table.name, ctx, c, hit, written=False)
                if kind == "upsert":
                    if not table.pk:
                        raise bad_request(f"{table.name.name} has no primary key to upsert by")
                    new, affected = mutate.merge_duplicates(current, rows, table.pk, p.keys)
                elif prefer.resolution == "ignore-duplicates":
                    new, affected = mutate.ignore_duplicates(current, rows, keys)
                elif merges:
                    new, affected = mutate.merge_duplicates(current, rows, keys, columns or p.keys)
                else:
                    new, affected = mutate.insert(current, rows)
                if merges:
                    obey(self.catalog, table.name, ctx, "update", affected.join(hit.select(*at), at, "left_semi"))
                    if set(at) != set(table.pk):
                        mutate.restrict(self.catalog, self.store, table, hit, new, columns or p.keys)
            else:
                condition = mutate.where_of(self.catalog, table, where, ctx, command)
                if kind == "update":
                    if not p.rows or not p.rows[0]:
                        raise bad_request("there is nothing to set")
                    row = {k: v for k, v in p.rows[0].items() if not columns or k in columns}
                    new, affected = mutate.update(current, condition, mutate.values_of(table, row))
                    obey(self.catalog, table.name, ctx, "update", affected)
                    mutate.restrict(self.catalog, self.store, table, mutate.delete(current, condition)[1], new, row)
                else:
                    new, affected = mutate.delete(current, condition)
                    mutate.restrict(self.catalog, self.store, table, affected, new)
            if prefer.max_affected is not None and affected.limit(prefer.max_affected + 1).count() > prefer.max_affected:
                raise bad_request(f"more than {prefer.max_affected} rows would be affected")
            if kind != "delete":
                mutate.check(self.catalog, self.store, table, new, affected)
            if prefer.transaction != "rollback":
                self.store.commit(table, new)
        return affected

    def _with_auto(self, table: TableDef, current: DataFrame, rows: DataFrame) -> DataFrame:
        """Generated keys follow the largest one; the body's rows are few enough to be numbered in one window."""
        for c in table.columns:
            if c.auto:
                top = current.agg(F.max(F.col(f"`{c.name}`"))).first()[0] or 0
                n = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + F.lit(top)
                rows = rows.withColumn(c.name, F.coalesce(F.col(f"`{c.name}`"), n.cast(c.type)))
        return rows

    def filtered(self, table: str, where: tuple[Tree, ...], ctx: Context | None = None) -> DataFrame:
        plan = self.plan(ctx)
        t = plan.catalog.table(table)
        return filtered(plan, t, plan.base(t), where)

    def ready(self) -> dict[str, Any]:
        """Whether the session answers, and how many tables are known."""
        try:
            ok = self.spark.range(1).count() == 1
        except PySparkException:
            ok = False
        return {"status": "ready" if ok else "unavailable", "tables": len(self.catalog.tables)}

    def subscribe(self, document: str, folder: str, variables: dict | None = None, ctx: Context | None = None) -> DataFrame:
        """The stream of a subscription document over the log of changes in folder."""
        from larkspur.graphql.resolve import subscription

        return subscription(self, document, variables or {}, ctx or Context(), folder)

    def graphql(self, document: str, variables: dict | None = None, ctx: Context | None = None, operation: str | None = None) -> dict:
        from larkspur.graphql.resolve import execute

        return execute(self, document, variables or {}, ctx or Context(), operation)


def _columns(df: DataFrame) -> tuple[ColumnDef, ...]:
    return tuple(ColumnDef(f.name, f.dataType, f.nullable, position=i) for i, f in enumerate(df.schema.fields, 1))
