"""Requests whole: catalog, headers, rendering, errors, routines, and the streams of changes."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

from pyspark.sql import functions as F

from larkspur import render
from larkspur.catalog import Context, Name, Relationship, TableDef, describe
from larkspur.engine import Engine
from larkspur.errors import ApiError, from_spark
from larkspur.functions import names
from larkspur.graphql.resolve import known_columns, typed_filter
from larkspur.operators import routines
from larkspur.operators.predicates import and_all, condition, or_all
from larkspur.operators.read import count_rows
from larkspur.plans import grammar, request
from larkspur.queries import frame
from larkspur.queries.search import registry
from larkspur.queries.writes import TOLD, values
from larkspur.sources import payload
from larkspur.sources.testdata import KEYS, catalog, scan
from larkspur.streaming import changes, state


def engine(spark, sf_dir, **kw) -> Engine:
    return Engine(spark, routines.with_routines(catalog(spark, sf_dir), *registry(sf_dir), *_routines(sf_dir)), **kw)


# --- the catalog -------------------------------------------------------------------------

TABLES = ", ".join(f"'{t}'" for t in KEYS)


@frame("catalog_tables", "select table_name, count(*) as n_columns, count(*) filter (where (table_name, column_name) in (" + ", ".join(f"('{t}', '{c}')" for t, pk in KEYS.items() for c in pk) + f")) as n_keys from information_schema.columns where table_name in ({TABLES}) group by 1")
def catalog_tables(spark, sf_dir):
    rows = [(t.name.name, len(t.columns), len(t.pk)) for t in catalog(spark, sf_dir).tables.values()]
    return spark.createDataFrame(rows, "table_name string, n_columns long, n_keys long")


@frame("catalog_columns", f"select table_name, column_name, ordinal_position::int as position from information_schema.columns where table_name in ({TABLES})")
def catalog_columns(spark, sf_dir):
    rows = [(c["table"], c["column"], c["position"]) for c in describe(catalog(spark, sf_dir))]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


FKS = [("nation_region", "nation", "n_regionkey", "region", "r_regionkey"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
       ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events_customer", "events", "user_id", "customer", "c_custkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id")]


@frame("catalog_references", " union all ".join(f"select '{k}' as name, (select count(*) from {a} where {c} in (select {d} from {b})) as n_held, (select count(distinct {c}) from {a}) as n_targets" for k, a, c, b, d in FKS))
def catalog_references(spark, sf_dir):
    """Each declared reference, followed: rows that have their target, and different targets. The one-to-one pair counts from its labels."""
    cat, out = catalog(spark, sf_dir), None
    for r in cat.relationships:
        first = next(x for x in cat.relationships if x.constraint == r.constraint)
        if r.kind not in ("m2o", "o2o") or first is not r:
            continue
        (a, b), = r.columns
        child, parent = scan(spark, sf_dir, r.table.name).select(F.col(a).alias("k")), scan(spark, sf_dir, r.target.name).select(F.col(b).alias("k"))
        held = child.join(parent, "k", "left_semi").agg(F.count("*").alias("n_held"))
        row = held.crossJoin(child.agg(F.countDistinct("k").alias("n_targets"))).select(F.lit(r.constraint).alias("name"), "n_held", "n_targets")  # two one-row aggregates
        out = row if out is None else out.union(row)
    return out


SIGNATURES = [("get_customer", "id", "setof", True), ("search_parts", "query,max_results?", "setof", True), ("order_stats", "", "table", True), ("order_total", "id", "scalar", True), ("customer_orders", "id", "setof", True), ("nearest", "query,k?", "setof", True), ("shout", "message", "scalar", True), ("shout", "message,times", "scalar", True), ("add_region", "name", "setof", False), ("total", "parts...", "scalar", True), ("whole", "body", "scalar", True)]


def _routines(sf_dir: str) -> list:
    def shout(spark, message: str):
        return message.upper() + "!"

    def shout_times(spark, message: str, times: int):
        return message.upper() + "!" * times

    def add_region(spark, name: str):
        r = scan(spark, sf_dir, "region")
        return r.agg((F.max("r_regionkey") + 1).alias("r_regionkey")).withColumn("r_name", F.lit(name))

    def total(spark, *parts: int):
        return sum(parts)

    def whole(spark, body: str):
        return json.dumps(body, sort_keys=True) if not isinstance(body, str) else body

    many = routines.routine("total", total, "scalar", composite=False)
    return [routines.routine("shout", shout, "scalar", composite=False), routines.routine("shout", shout_times, "scalar", composite=False), routines.routine("add_region", add_region, "setof", "volatile"), many, routines.routine("whole", whole, "scalar", composite=False)]


@frame("catalog_routines", values(SIGNATURES, "name, params, returns, safe"))
def catalog_routines(spark, sf_dir):
    shown = lambda p: p.name + ("..." if p.variadic else "" if p.required else "?")
    rows = [(r.name.name, ",".join(map(shown, r.params)), r.returns, r.safe) for r in (*registry(sf_dir), *_routines(sf_dir))]
    return spark.createDataFrame(rows, "name string, params string, returns string, safe boolean")


@frame("catalog_zones", values([("UTC", True), ("Europe/Paris", True), ("Asia/Tokyo", True), ("Moon/Base", False)], "zone, known"))
def catalog_zones(spark, sf_dir):
    zones = catalog(spark, sf_dir).timezones()
    return spark.createDataFrame([(z, z in zones) for z in ("UTC", "Europe/Paris", "Asia/Tokyo", "Moon/Base")], "zone string, known boolean")


@frame("jdbc_table", "select n_nationkey, n_name, n_regionkey from nation")
def jdbc_table(spark, sf_dir):
    """The nations through a database: written to an embedded one, read back in key ranges."""
    url = payload.derby(spark, scan(spark, sf_dir, "nation"), "nation")
    return payload.jdbc(spark, url, "nation", "N_NATIONKEY", (0, 25), 3, driver=payload.DERBY)


# --- rendering and headers ---------------------------------------------------------------


@frame("json_array", """select '[' || string_agg('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}', ',' order by r_regionkey) || ']' as body from region""")
def json_array(spark, sf_dir):
    return spark.createDataFrame([(engine(spark, sf_dir).request("GET", "/region", "order=r_regionkey").text(),)], "body string")


@frame("json_key_order", """select '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' order by r_regionkey) || ']' as body from region""")
def json_key_order(spark, sf_dir):
    return spark.createDataFrame([(engine(spark, sf_dir, key_order="select").request("GET", "/region", "order=r_regionkey").text(),)], "body string")


ONE = "application/vnd.larkspur.object+json"


@frame("json_singular", """select 'one' as what, 200 as status, '{"r_name":"' || r_name || '"}' as body from region where r_regionkey = 1 union all select 'none', 404, 'no_rows' union all select 'none, null allowed', 200, 'null' union all select 'many', 406, 'many_rows'""")
def json_singular(spark, sf_dir):
    e = engine(spark, sf_dir)
    out = []
    for what, q, accept in (("one", "r_regionkey=eq.1", ONE), ("none", "r_regionkey=eq.99", ONE), ("none, null allowed", "r_regionkey=eq.99", ONE + ";nulls=null"), ("many", "", ONE)):
        r = e.request("GET", "/region", f"select=r_name&{q}", {"Accept": accept})
        out.append((what, r.status, r.body["code"] if r.status >= 400 else r.text()))
    return spark.createDataFrame(out, "what string, status int, body string")


@frame("json_singular_or_null", """select 0 as n, 'null' as body union all select 1, '{"r_regionkey":0}' union all select 2, '[{"r_regionkey":0},{"r_regionkey":1}]'""")
def json_singular_or_null(spark, sf_dir):
    e = engine(spark, sf_dir)
    rows = [(n, render.dumps(render.singular_or_null(render.rows(e.frame("region", f"select=r_regionkey&order=r_regionkey&limit={n}"))))) for n in (0, 1, 2)]
    return spark.createDataFrame(rows, "n int, body string")


@frame("json_without_nulls", """select c_custkey, '{"c_custkey":' || c_custkey || case when o is null then '' else ',"o_orderkey":' || o end || '}' as body from customer left join (select o_custkey, min(o_orderkey) as o from orders where o_totalprice > 300000 group by 1) on o_custkey = c_custkey""")
def json_without_nulls(spark, sf_dir):
    o = scan(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    c = scan(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    return c.select("c_custkey", render.row_json(c, strip=True).alias("body"))


@frame("explain_plan", values([("text", True, True), ("verbose", True, True)], "what, scans, pushed"))
def explain_plan(spark, sf_dir):
    e, out = engine(spark, sf_dir), []
    for what, options in (("text", ""), ("verbose", ";options=analyze|verbose")):
        r = e.request("GET", "/orders", "o_totalprice=gt.5", {"Accept": "application/vnd.larkspur.plan+text" + options})
        out.append((what, "Scan parquet" in r.body or "FileScan parquet" in r.body, "GreaterThan(o_totalprice,5.0)" in r.body))
    return spark.createDataFrame(out, "what string, scans boolean, pushed boolean")


RANGES = [("page", "limit=10&offset=20", {}), ("header", "", {"Range": "5-14"}), ("open header", "o_orderkey=lte.40", {"Range": "3-"}), ("beyond", "o_orderkey=eq.-1", {}), ("both", "limit=4", {"Range": "2-99"})]


@frame("content_ranges", """with n as (select count(*) as n from orders), m as (select count(*) as m from orders where o_orderkey <= 40)
select 'page' as what, 206 as status, '20-29/' || n as content_range from n union all select 'header', 206, '5-14/' || n from n union all select 'open header', 206, '3-' || (m - 1) || '/' || m from m
union all select 'beyond', 200, '*/0' union all select 'both', 206, '2-5/' || n from n""")
def content_ranges(spark, sf_dir):
    e = engine(spark, sf_dir)
    got = [(what, e.request("GET", "/orders", f"select=o_orderkey&{q}".rstrip("&"), h | {"Prefer": "count=exact"})) for what, q, h in RANGES]
    return spark.createDataFrame([(what, r.status, r.headers["content-range"]) for what, r in got], "what string, status int, content_range string")


@frame("range_header", "select o_orderkey from orders order by o_orderkey limit 10 offset 5")
def range_header(spark, sf_dir):
    got = engine(spark, sf_dir).request("GET", "/orders", "select=o_orderkey&order=o_orderkey", {"Range": "5-14"})
    return spark.createDataFrame([(r["o_orderkey"],) for r in got.body], "o_orderkey long")


@frame("count_kinds", "select 'exact' as kind, count(*) as n from orders where o_totalprice > 100000 union all select 'estimated', count(*) from nation where n_regionkey = 1 union all select 'planned under the whole', 1")
def count_kinds(spark, sf_dir):
    """exact counts; an estimate of few rows is exact; a planned count is the optimizer's, no more than it takes the table for."""
    plan = engine(spark, sf_dir).plan()
    read = lambda t, q: grammar.parse_query(q, t).read
    some, all_ = (count_rows(plan, read("orders", q), "planned") for q in ("o_totalprice=gt.100000", ""))
    rows = [("exact", count_rows(plan, read("orders", "o_totalprice=gt.100000"))), ("estimated", count_rows(plan, read("nation", "n_regionkey=eq.1"), "estimated")), ("planned under the whole", int(0 < some <= all_))]
    return spark.createDataFrame(rows, "kind string, n long")


FAILS = [
    ("no such table", "GET", "/nothing", "", {}, None, 404, "table_not_found"),
    ("no such column", "GET", "/orders", "select=nope", {}, None, 404, "column_not_found"),
    ("no such filter column", "GET", "/orders", "nope=eq.1", {}, None, 404, "column_not_found"),
    ("no such relation", "GET", "/orders", "select=part(p_name)", {}, None, 400, "relationship_not_found"),
    ("no such operator", "GET", "/orders", "o_orderkey=near.1", {}, None, 400, "invalid_request"),
    ("a bad literal", "GET", "/orders", "o_orderkey=eq.one", {}, None, 400, "invalid_request"),
    ("is of no boolean", "GET", "/orders", "o_orderkey=is.true", {}, None, 400, "invalid_request"),
    ("a backward range", "GET", "/orders", "", {"Range": "9-3"}, None, 416, "range_not_satisfiable"),
    ("a range beyond", "GET", "/nation", "offset=100", {"Prefer": "count=exact"}, None, 416, "range_not_satisfiable"),
    ("a strict preference", "GET", "/nation", "", {"Prefer": "handling=strict, colour=red"}, None, 400, "invalid_request"),
    ("another schema", "GET", "/nation", "", {"Accept-Profile": "hidden"}, None, 406, "schema_not_exposed"),
    ("another media type", "GET", "/nation", "", {"Accept": "image/png"}, None, 406, "media_type"),
    ("another content type", "POST", "/region", "", {"Content-Type": "image/png"}, "x", 400, "invalid_request"),
    ("a body of no JSON", "POST", "/region", "", {}, "{", 400, "invalid_request"),
    ("another method", "TRACE", "/nation", "", {}, None, 405, "method"),
    ("a deep path", "GET", "/nation/1", "", {}, None, 404, "resource"),
    ("no such function", "GET", "/rpc/nothing", "", {}, None, 404, "function_not_found"),
    ("a function that writes, by GET", "GET", "/rpc/add_region", "name=X", {}, None, 405, "volatile_function"),
    ("arguments of no overload", "POST", "/rpc/shout", "", {}, '{"loud": 1}', 404, "no_overload"),
    ("an argument that is missing", "GET", "/rpc/get_customer", "", {}, None, 404, "no_overload"),
]


@frame("error_responses", values([(f[0], f[6], f[7]) for f in FAILS], "what, status, code"))
def error_responses(spark, sf_dir):
    e = engine(spark, sf_dir)
    got = [(f[0], e.request(f[1], f[2], f[3], f[4], f[5])) for f in FAILS]
    return spark.createDataFrame([(what, r.status, r.body["code"] if isinstance(r.body, dict) else "none") for what, r in got], TOLD)


@frame("error_states", values([("22003", 400, "invalid_value"), ("23505", 409, "constraint"), ("42501", 403, "insufficient_privilege"), ("42704", 400, "invalid_request"), ("XX000", 500, "internal")], "what, status, code"))
def error_states(spark, sf_dir):
    """Engine errors by the class of their SQLSTATE; an internal one keeps its text to itself unless debugging."""
    out = []
    for s in ("22003", "23505", "42501", "42704", "XX000"):
        err = from_spark(ValueError(f"secret text SQLSTATE: {s}"))
        hidden = err.to_dict(debug=False)
        out.append((s, err.status, hidden["code"] if err.kind != "internal" or "secret" not in hidden["message"] else "leak"))
    return spark.createDataFrame(out, TOLD)


@frame("root_document", f"select distinct table_name as name, 'table' as kind from information_schema.columns where table_name in ({TABLES})")
def root_document(spark, sf_dir):
    body = engine(spark, sf_dir).request("GET", "/").body
    return spark.createDataFrame([(r["name"], r["kind"]) for r in body], "name string, kind string")


@frame("allowed_methods", values([("/region", "OPTIONS,GET,HEAD,POST,PUT,PATCH,DELETE"), ("/rpc/shout", "OPTIONS,GET,HEAD,POST"), ("/frozen", "OPTIONS,GET,HEAD")], "path, allow"))
def allowed_methods(spark, sf_dir):
    e = engine(spark, sf_dir)
    region = e.catalog.table("region")
    frozen = replace(region, name=Name("public", "frozen"), insertable=False, updatable=False, deletable=False)
    e.handle.current = replace(e.catalog, tables=e.catalog.tables | {frozen.name: frozen})
    return spark.createDataFrame([(p, e.request("OPTIONS", p).headers["allow"]) for p in ("/region", "/rpc/shout", "/frozen")], "path string, allow string")


ACTIONS = [("GET", "/", "root", True), ("GET", "/t", "read", True), ("HEAD", "/t", "read", True), ("POST", "/t", "insert", False), ("PATCH", "/t", "update", False), ("PUT", "/t", "upsert", False), ("DELETE", "/t", "delete", False), ("OPTIONS", "/t", "info", True), ("GET", "/rpc/f", "call", True), ("POST", "/rpc/f", "call", False)]


@frame("request_actions", values(ACTIONS, "method, path, kind, read_only"))
def request_actions(spark, sf_dir):
    rows = [(m, p, (a := request.parse_action(m, p)).kind, a.read_only) for m, p, _, _ in ACTIONS]
    return spark.createDataFrame(rows, "method string, path string, kind string, read_only boolean")


PREFERS = [("return=representation, count=exact", "return=representation, count=exact"), ("resolution=merge-duplicates;missing=default", "resolution=merge-duplicates, missing=default"), ("count=exact, count=planned", "count=exact"), ("colour=red, tx=rollback", "tx=rollback"), ("timezone=Asia/Tokyo, max-affected=5", "timezone=Asia/Tokyo, max-affected=5")]


@frame("preferences_applied", values(PREFERS, "asked, applied"))
def preferences_applied(spark, sf_dir):
    return spark.createDataFrame([(p, ", ".join(request.parse_prefer(p).applied)) for p, _ in PREFERS], "asked string, applied string")


@frame("schema_profiles", values([("one", "public", "n_nationkey,n_name,n_regionkey"), ("two", "api", "n_name")], "what, schema, keys"))
def schema_profiles(spark, sf_dir):
    e = engine(spark, sf_dir)
    n = e.catalog.table("nation")
    api = TableDef(Name("api", "nation"), lambda s: n.load(s).select("n_name"), tuple(c for c in n.columns if c.name == "n_name"))
    e.handle.current = replace(e.catalog, tables=e.catalog.tables | {api.name: api}, schemas=("public", "api"))
    e.key_order = "select"
    out = [(what, s, ",".join(e.request("GET", "/nation", "limit=1", {"Accept-Profile": s}).body[0])) for what, s in (("one", "public"), ("two", "api"))]
    return spark.createDataFrame(out, "what string, schema string, keys string")


# --- expressions -------------------------------------------------------------------------


@frame("empty_logic", "select n_nationkey, true as every, false as any_ from nation")
def empty_logic(spark, sf_dir):
    return scan(spark, sf_dir, "nation").select("n_nationkey", and_all([]).alias("every"), or_all([]).alias("any_"))


TYPED = [("String", "c_name", {"startsWith": "Customer", "endsWith": "7", "in": None}), ("Int", "c_custkey", {"gte": 10, "lt": 40}), ("Float", "c_acctbal", {"gt": 0, "lte": 5000}), ("UUID", "c_mktsegment", {"in": ["BUILDING", "MACHINERY"]})]


@frame("typed_filters", "select 'String' as kind, c_custkey from customer where c_name like 'Customer%' and c_name like '%7' union all select 'Int', c_custkey from customer where c_custkey >= 10 and c_custkey < 40 union all select 'Float', c_custkey from customer where c_acctbal > 0 and c_acctbal <= 5000 union all select 'UUID', c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') union all select 'Boolean', c_custkey from customer where (case when c_acctbal > 9000 then null else c_acctbal < 0 end) is false")
def typed_filters(spark, sf_dir):
    t, out = catalog(spark, sf_dir).table("customer"), None
    for kind, column, spec in TYPED:
        spec = {k: v for k, v in spec.items() if v is not None}
        rows = scan(spark, sf_dir, "customer").where(condition(t, typed_filter(t, column, spec, kind))).select(F.lit(kind).alias("kind"), "c_custkey")
        out = rows if out is None else out.union(rows)
    flagged = scan(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 9000, None).otherwise(F.col("c_acctbal") < 0).alias("owes"))
    from larkspur.catalog import table_of

    f = table_of(flagged, "flagged")
    return out.union(flagged.where(condition(f, typed_filter(f, "owes", {"eq": False}))).select(F.lit("Boolean"), "c_custkey"))


WRONG = [("c_custkey", "like"), ("c_custkey", "startsWith"), ("c_acctbal", "in"), ("c_name", "gt"), ("c_name", "near")]


@frame("typed_filter_refusals", values([(c, o, "invalid_request") for c, o in WRONG], "column_name, op, code"))
def typed_filter_refusals(spark, sf_dir):
    t, out = catalog(spark, sf_dir).table("customer"), []
    for column, op in WRONG:
        try:
            typed_filter(t, column, {op: 1})
            out.append((column, op, "taken"))
        except ApiError as e:
            out.append((column, op, e.code))
    return spark.createDataFrame(out, "column_name string, op string, code string")


@frame("known_columns", "select n_name, n_nationkey from nation")
def known(spark, sf_dir):
    t = catalog(spark, sf_dir).table("nation")
    return scan(spark, sf_dir, "nation").select(*known_columns(t, ["n_name", "nope", "n_nationkey"]))


@frame("computed_relation", "select c_custkey, count(o_orderkey) as n from customer left join (select * from orders where o_orderstatus = 'O' and o_totalprice > 150000) on o_custkey = c_custkey group by 1")
def computed_relation(spark, sf_dir):
    """A relation that a function computes: a customer's large open orders."""
    cat = catalog(spark, sf_dir)
    big = Relationship(Name("public", "customer"), Name("public", "orders"), (("c_custkey", "o_custkey"),), "o2m", "large_open", compute=lambda df: df.where("o_orderstatus = 'O' and o_totalprice > 150000"))
    e = Engine(spark, replace(cat, relationships=(*cat.relationships, big)))
    return e.frame("customer", "select=c_custkey,large_open(o_orderkey)").select("c_custkey", F.size("large_open").cast("long").alias("n"))


@frame("agg_cast", "select o_orderstatus, floor(avg(o_totalprice))::int as mean, count(*)::varchar as n from orders group by 1")
def agg_cast(spark, sf_dir):
    return engine(spark, sf_dir).frame("orders", "select=o_orderstatus,avg(o_totalprice)::int:mean,count()::text:n")


@frame("current_time", "select abs(extract(epoch from (now() - now()))) < 5 as recent")
def current_time(spark, sf_dir):
    now = dt.datetime.now(dt.timezone.utc).timestamp()
    got = changes.capture(scan(spark, sf_dir, "region").limit(0), scan(spark, sf_dir, "region").limit(1), ["r_regionkey"], "region")
    return got.select((F.abs(F.col("at").cast("double") - F.lit(now)) < 300).alias("recent"))


NAMED = [("order_items", "OrderItems", "orderItems", "order_item", "order_items"), ("category", "Category", "category", "category", "categories"), ("box", "Box", "box", "box", "boxes"), ("class", "Class", "class", "class", "classes"), ("buses", "Buses", "buses", "buse", "buses"), ("status", "Status", "status", "status", "status")]


@frame("name_inflection", values([n[:5] for n in NAMED], "name, pascal, camel, singular, plural"))
def name_inflection(spark, sf_dir):
    rows = [(n, names.pascal(n), names.camel(n), names.singular(n), names.plural(n)) for n, *_ in NAMED]
    return spark.createDataFrame(rows, "name string, pascal string, camel string, singular string, plural string")


@frame("name_quoting", values([("a", "`a`", True, False), ("a`b", "`a``b`", False, False), ("select", "`select`", True, True), ("1st", "`1st`", False, False), ("x y", "`x y`", False, False)], "name, quoted, valid, keyword"))
def name_quoting(spark, sf_dir):
    rows = [(n, names.quote(n), names.is_valid(n), names.is_keyword(n)) for n in ("a", "a`b", "select", "1st", "x y")]
    return spark.createDataFrame(rows, "name string, quoted string, valid boolean, keyword boolean")


@frame("percent_decoding", "select p_partkey from part where p_name like '% %' and p_name like 'red %' or p_name = 'a+b'")
def percent_decoding(spark, sf_dir):
    """Values are decoded, a plus sign is itself."""
    return engine(spark, sf_dir).frame("part", "select=p_partkey&or=(and(p_name.like.%2A%20%2A,p_name.like.red%20%2A),p_name.eq.a+b)")


@frame("key_digests", "select c_custkey, sha256(c_name) as digest from customer")
def key_digests(spark, sf_dir):
    return scan(spark, sf_dir, "customer").select("c_custkey", names.key_digest(F.col("c_name")).alias("digest"))


# --- routines ----------------------------------------------------------------------------

CALLS = [
    ("json arguments", "POST", "shout", "", {}, '{"message": "hey"}', '[{"shout":"HEY!"}]'),
    ("json arguments as text", "POST", "shout", "", {}, '{"message": "hey", "times": "2"}', '[{"shout":"HEY!!"}]'),
    ("form arguments", "POST", "shout", "", {"Content-Type": "application/x-www-form-urlencoded"}, "message=well+done", '[{"shout":"WELL DONE!"}]'),
    ("query arguments", "GET", "shout", "message=hey", {}, None, '[{"shout":"HEY!"}]'),
    ("underscored query arguments", "GET", "shout", "_message=hey&_times=3", {}, None, '[{"shout":"HEY!!!"}]'),
    ("a text body", "POST", "shout", "", {"Content-Type": "text/plain"}, "raw", '[{"shout":"RAW!"}]'),
    ("an xml body", "POST", "whole", "", {"Content-Type": "application/xml"}, "<a/>", '[{"whole":"<a/>"}]'),
    ("an array body", "POST", "whole", "", {"Prefer": "params=single-object"}, '{"b": 1, "a": 2}', '[{"whole":"{\\"a\\": 2, \\"b\\": 1}"}]'),
]


@frame("rpc_argument_forms", values([(c[0], c[6]) for c in CALLS], "what, body"))
def rpc_argument_forms(spark, sf_dir):
    e = engine(spark, sf_dir)
    return spark.createDataFrame([(what, e.request(m, f"/rpc/{f}", q, h, b).text()) for what, m, f, q, h, b, _ in CALLS], "what string, body string")


@frame("rpc_binary_body", "select 3 as n")
def rpc_binary_body(spark, sf_dir):
    raw = payload.parse(b"\x00\xff\x01", "application/octet-stream").raw
    r, args = routines.bind([routines.routine("size", lambda spark, body: len(body), "scalar", composite=False)], None, raw)
    return spark.createDataFrame([(routines.call(spark, r, args, True),)], "n int")


@frame("rpc_positional", "select * from part where p_name ilike '%red%' order by p_partkey limit 3")
def rpc_positional(spark, sf_dir):
    r, args = routines.bind([r for r in registry(sf_dir) if r.name.name == "search_parts"], positional=("red", "3"))
    return routines.call(spark, r, args, True)


@frame("rpc_shapes", """select 'scalar' as what, 'HEY!' as body union all select 'table', '{"large":' || count(*) filter (where o_totalprice > 200000) || ',"open":' || count(*) filter (where o_orderstatus = 'O') || ',"total":' || count(*) || '}' from orders""")
def rpc_shapes(spark, sf_dir):
    """With the older shapes a lone column named as its function is un-nested, and one row is bare."""
    e = engine(spark, sf_dir, rpc_compat=True)
    text = lambda b: b if isinstance(b, str) else render.dumps(b)
    return spark.createDataFrame([("scalar", text(e.request("GET", "/rpc/shout", "message=hey").body)), ("table", text(e.request("GET", "/rpc/order_stats").body))], "what string, body string")


@frame("rpc_read_of_result", "select c_custkey, c_name from customer where c_custkey = 17")
def rpc_read_of_result(spark, sf_dir):
    got = engine(spark, sf_dir).request("GET", "/rpc/get_customer", "id=17&select=c_custkey,c_name").body
    return spark.createDataFrame([(r["c_custkey"], r["c_name"]) for r in got], "c_custkey long, c_name string")


@frame("rpc_volatile_insert", "select max(r_regionkey) + 1 as r_regionkey, 'NEW' as r_name from region")
def rpc_volatile_insert(spark, sf_dir):
    got = engine(spark, sf_dir).request("POST", "/rpc/add_region", "", {}, '{"name": "NEW"}').body
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in got], "r_regionkey int, r_name string")


@frame("request_hook", values([("anon", 403, "blocked"), ("guest", 200, None)], "what, status, code"))
def request_hook(spark, sf_dir):
    """A function ahead of each request may refuse it or change who asks."""

    def before(e, method, path, ctx):
        if ctx.role == "anon":
            raise ApiError("forbidden", "blocked", "not now")
        return Context("reader", ctx.claims)

    e = engine(spark, sf_dir, before=before)
    got = [(who, e.request("GET", "/region", "", {}, None, Context(who))) for who in ("anon", "guest")]
    return spark.createDataFrame([(who, r.status, r.body["code"] if isinstance(r.body, dict) else None) for who, r in got], TOLD)


@frame("readiness", f"select 'ready' as status, {len(KEYS)} as tables")
def readiness(spark, sf_dir):
    got = engine(spark, sf_dir).ready()
    return spark.createDataFrame([(got["status"], got["tables"])], "status string, tables int")


# --- GraphQL's schema --------------------------------------------------------------------


@frame("gql_schema_fields", f"""with t as (select distinct table_name from information_schema.columns where table_name in ({TABLES}))
select 'Query' as type_name, 2 * count(*) as n from t union all select 'Mutation', 6 * count(*) from t union all select 'Subscription', count(*) from t union all select 'Customer', 5 + 3 union all select 'Region', 2 + 1""")
def gql_schema_fields(spark, sf_dir):
    """How many fields the generated types have, by introspection: customers have columns, a nation, orders and events."""
    types = engine(spark, sf_dir).graphql("{ __schema { types { name fields { name } } } }")["data"]["__schema"]["types"]
    n = {t["name"]: len(t["fields"] or []) for t in types}
    return spark.createDataFrame([(k, n[k]) for k in ("Query", "Mutation", "Subscription", "Customer", "Region")], "type_name string, n long")


@frame("gql_scalars", values([("c_acctbal", "Float"), ("c_custkey", "BigInt"), ("c_mktsegment", "String"), ("c_name", "String"), ("c_nationkey", "Int"), ("event_id", "BigInt"), ("event_type", "String"), ("props", "JSON"), ("ts", "DateTime"), ("user_id", "BigInt"), ("value", "Float")], "column_name, kind"))
def gql_scalars(spark, sf_dir):
    e, out = engine(spark, sf_dir), []
    for t in ("Customer", "Event"):
        for f in e.graphql('{ __type(name: "%s") { fields { name type { kind name ofType { name kind } } } } }' % t)["data"]["__type"]["fields"]:
            inner = f["type"]["ofType"] or f["type"]
            if inner["kind"] == "SCALAR":
                out.append((f["name"], inner["name"]))
    return spark.createDataFrame(out, "column_name string, kind string")


@frame("gql_list_names", "select n_nationkey from nation where n_regionkey = 1")
def gql_list_names(spark, sf_dir):
    got = engine(spark, sf_dir, list_prefix="all", list_suffix="List").graphql("{ allNationList(filter: {n_regionkey: 1}) { n_nationkey } }")["data"]["allNationList"]
    return spark.createDataFrame([(r["n_nationkey"],) for r in got], "n_nationkey int")


# --- streams of changes ------------------------------------------------------------------


def _folder(spark, label: str) -> str:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='larkspur-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _versions(spark, sf_dir):
    c = scan(spark, sf_dir, "customer")
    return c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))


def _logged(spark, sf_dir) -> str:
    """A log with the changes of customers, those of another channel, and payloads that do not parse."""
    folder = _folder(spark, "changes")
    old, new = _versions(spark, sf_dir)
    rows = changes.capture(old, new, ["c_custkey"], "customer")
    changes.log(rows, folder)
    changes.log(rows.limit(5).withColumn("channel", F.lit("larkspur_public_other")), folder)
    changes.log(rows.limit(3).withColumns({"old": F.lit(None).cast("string"), "new": F.lit(None).cast("string")}), folder)
    return folder


CDC = """v1 as (select * from customer where c_custkey % 5 <> 0), v2 as (select c_custkey, c_name, c_nationkey, case when c_acctbal < 0 then 0 else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 7 <> 0),
d as (select case when a.c_custkey is null then 'INSERT' when b.c_custkey is null then 'DELETE' else 'UPDATE' end as operation, coalesce(b.c_custkey, a.c_custkey) as c_custkey, case when b.c_custkey is null then a.c_acctbal else b.c_acctbal end as c_acctbal, coalesce(b.c_mktsegment, a.c_mktsegment) as c_mktsegment
from v1 a full join v2 b on a.c_custkey = b.c_custkey where a.c_custkey is null or b.c_custkey is null or a.c_acctbal <> b.c_acctbal)"""


@frame("stream_table_changes", f"with {CDC} select operation, c_custkey, c_acctbal from d where c_mktsegment = 'BUILDING'")
def stream_table_changes(spark, sf_dir):
    """Captured changes through the log and a table's filtered subscription: the new row, the old one of a deletion."""
    cat = catalog(spark, sf_dir)
    s = changes.table_stream(spark, cat, cat.table("customer"), _logged(spark, sf_dir), F.col("c_mktsegment") == "BUILDING")
    return changes.drain(s.select("operation", "c_custkey", "c_acctbal"), _folder(spark, "out"))


@frame("gql_subscription", f"with {CDC} select operation, c_custkey, c_acctbal as balance from d where c_acctbal > 5000")
def gql_subscription(spark, sf_dir):
    s = engine(spark, sf_dir).subscribe("subscription { customer(filter: {c_acctbal: {gt: 5000}}) { c_custkey balance: c_acctbal } }", _logged(spark, sf_dir))
    return changes.drain(s, _folder(spark, "out"))


@frame("stream_policy", f"with {CDC} select c_custkey from d where c_mktsegment = 'MACHINERY'")
def stream_policy(spark, sf_dir):
    from larkspur.catalog import Policy

    cat = replace(catalog(spark, sf_dir), policies=(Policy(Name("public", "customer"), ("agent",), "select", lambda c: F.col("c_mktsegment") == c.claims["segment"]),))
    s = changes.table_stream(spark, cat, cat.table("customer"), _logged(spark, sf_dir), None, Context("agent", {"segment": "MACHINERY"}))
    return changes.drain(s.select("c_custkey"), _folder(spark, "out"))


@frame("conditional_notice", f"with {CDC} select operation, c_custkey from d where c_acctbal > 9000")
def conditional_notice(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    rows = changes.notify_where(changes.capture(old, new, ["c_custkey"], "customer"), old.schema, F.col("c_acctbal") > 9000)
    return rows.select("operation", F.get_json_object(F.coalesce("new", "old"), "$.c_custkey").cast("long").alias("c_custkey"))


@frame("config_notice", f"""with {CDC} select 'larkspur_config_change' as channel, '{{"table":"customer","operation":"' || operation || '","tenant_id":"' || c_custkey || '"}}' as payload from d""")
def config_notice(spark, sf_dir):
    old, new = (v.withColumnRenamed("c_custkey", "tenant_id") for v in _versions(spark, sf_dir))
    return changes.config_changes(changes.capture(old, new, ["tenant_id"], "customer"))


@frame("channel_names", f"select 'larkspur_public_' || table_name as channel from (select distinct table_name from information_schema.columns where table_name in ({TABLES}))")
def channel_names(spark, sf_dir):
    return spark.createDataFrame([(changes.channel_name(n.name, n.schema),) for n in changes.subscription_fields(catalog(spark, sf_dir)).values()], "channel string")


@frame("broker_fan_out", f"with {CDC}, n as (select operation, count(*) as n from d group by 1) select 'one' as who, operation, n from n union all select 'two', operation, n from n where operation = 'INSERT' union all select 'late', '-', 5::bigint")
def broker_fan_out(spark, sf_dir):
    """Two subscribers of one channel, one of them filtered, and one of a channel opened later; those of no channel are refused."""
    folder = _logged(spark, sf_dir)
    b, seen = changes.Broker(spark, folder), {}
    b.start([changes.channel_name("customer")])
    for bad in (lambda: b.start([]), lambda: b.subscribe("unheard", lambda d, i: None)):
        try:
            bad()
            seen["taken", "-"] = -1
        except ApiError:
            pass

    def taker(who, whole=False):
        def take(batch, _):
            for r in batch.where("new is not null or old is not null").groupBy(F.lit("-").alias("operation") if whole else "operation").count().collect():
                seen[who, r["operation"]] = seen.get((who, r["operation"]), 0) + r["count"]

        return take

    b.subscribe(changes.channel_name("customer"), taker("one"), once=True)
    b.subscribe(changes.channel_name("customer"), taker("two"), F.col("operation") == "INSERT", once=True)
    b.subscribe_or_create("larkspur_public_other", taker("late", True), once=True)
    for q in b.queries:
        q.awaitTermination(600)
    b.stop()
    return spark.createDataFrame([(*k, n) for k, n in seen.items()], "who string, operation string, n long")


def _events_stream(spark, sf_dir, *columns: str):
    """The events as a stream of one file."""
    folder = _folder(spark, "events")
    scan(spark, sf_dir, "events").select(*columns).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


@frame("debounced", """with e as (select event_type, ts, row_number() over (partition by event_type order by ts) as i from events),
n as materialized (select a.event_type, a.i, b.i as j from e a asof join e b on b.event_type = a.event_type and a.ts + interval 6 hour <= b.ts)
select * from (with recursive k as (select event_type, 1::bigint as i from e where i = 1 union all select n.event_type, n.j from k join n on n.event_type = k.event_type and n.i = k.i)
select event_type, count(*) as n from k group by 1)""")
def debounced(spark, sf_dir):
    """At most one notice a kind of event in any six hours."""
    s = state.debounce(_events_stream(spark, sf_dir, "event_type", "ts"), "event_type", "ts", 6 * 3_600_000)
    return changes.drain(s, _folder(spark, "out")).groupBy("event_type").agg(F.count("*").alias("n"))


@frame("rate_limited", """with recursive e as (select event_type as k, epoch_us(ts) as t, row_number() over (partition by event_type order by ts) as i from events),
b as (select k, i, t, 2::bigint * 3600000000 * 3 as tokens, true as ok from e where i = 1),
r as (select k, i, t, tokens - 3 * 3600000000 as tokens, 1::bigint as n from b
 union all select e.k, e.i, e.t, case when least(2 * 3 * 3600000000, r.tokens + e.t - r.t) >= 3 * 3600000000 then least(2 * 3 * 3600000000, r.tokens + e.t - r.t) - 3 * 3600000000 else least(2 * 3 * 3600000000, r.tokens + e.t - r.t) end,
 r.n + case when least(2 * 3 * 3600000000, r.tokens + e.t - r.t) >= 3 * 3600000000 then 1 else 0 end from r join e on e.k = r.k and e.i = r.i + 1)
select k as event_type, max(n) as allowed from r group by 1""")
def rate_limited(spark, sf_dir):
    """Two tokens for each kind of event, one more every three hours."""
    s = state.rate_limit(_events_stream(spark, sf_dir, "event_type", "ts"), "event_type", "ts", 2, 1 / (3 * 3600))
    return changes.drain(s, _folder(spark, "out"), one_batch=True).groupBy("event_type").agg(F.count_if("allowed").alias("allowed"))


@frame("health_checked", """with recursive e as (select event_type as k, value > 20 as ok, row_number() over (partition by event_type order by ts, event_id) as i from events),
r as (select k, 0::bigint as i, true as up, 0 as good, 0 as bad, 0::bigint as n_up from e where i = 1
 union all select e.k, e.i, case when not r.up and e.ok and r.good + 1 >= 2 then true when r.up and not e.ok and r.bad + 1 >= 3 then false else r.up end, case when e.ok then r.good + 1 else 0 end, case when e.ok then 0 else r.bad + 1 end,
 r.n_up + case when (case when not r.up and e.ok and r.good + 1 >= 2 then true when r.up and not e.ok and r.bad + 1 >= 3 then false else r.up end) then 1 else 0 end from r join e on e.k = r.k and e.i = r.i + 1)
select k as event_type, max(n_up) as n_healthy from r group by 1""")
def health_checked(spark, sf_dir):
    """Up after two successes in a row, down after three failures."""
    s = _events_stream(spark, sf_dir, "event_type", "ts", "event_id", "value").withColumn("ok", F.coalesce(F.col("value") > 20, F.lit(False)))
    return changes.drain(state.health_states(s, "event_type", "ts", "ok", then=["event_id"]), _folder(spark, "out")).groupBy("event_type").agg(F.count_if("healthy").alias("n_healthy"))
