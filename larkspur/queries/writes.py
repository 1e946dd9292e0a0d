"""Mutations through the engine: documents, requests and bodies, and the tables after them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from larkspur.catalog import Context, Name, Policy
from larkspur.engine import Engine
from larkspur.errors import ApiError
from larkspur.operators.builder import Insert, Update
from larkspur.queries import frame
from larkspur.sources.testdata import catalog, scan

C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
TOLD = "what string, status int, code string"


def engine(spark, sf_dir, **changed) -> Engine:
    from dataclasses import replace

    return Engine(spark, replace(catalog(spark, sf_dir), **changed))


def values(rows: list[tuple], columns: str) -> str:
    """Stated rows as SQL."""
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "select * from (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({columns})"


def after(name: str, document: str, table: str, query: str, sql: str) -> None:
    """A table after a mutation document."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        got = e.graphql(document)
        if "errors" in got:
            raise ApiError("bad_request", "mutation", str(got["errors"]))
        return e.frame(table, query)

    frame(name, sql)(run)


def returned(name: str, document: str, field: str, schema: str, sql: str) -> None:
    """What a mutation document gives back."""

    def run(spark, sf_dir):
        got = engine(spark, sf_dir).graphql(document)["data"][field]
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in (got if isinstance(got, list) else [got] if got else [])], schema)

    frame(name, sql)(run)


N = "n_nationkey, n_name, n_regionkey"
after("gql_insert_many", 'mutation { insertNation(objects: [{n_nationkey: 100, n_name: "ATLANTIS", n_regionkey: 1}, {n_nationkey: 101, n_name: "LEMURIA"}]) { n_nationkey } }', "nation", "", f"select {N} from nation union all select 100, 'ATLANTIS', 1 union all select 101, 'LEMURIA', null")
returned("gql_insert_one", 'mutation { insertNationOne(objects: {n_nationkey: 100, n_name: "ATLANTIS", n_regionkey: 1}) { n_nationkey n_name } }', "insertNationOne", "n_nationkey int, n_name string", "select 100 as n_nationkey, 'ATLANTIS' as n_name")
after("gql_update", 'mutation { updateCustomer(where: {c_acctbal: {lt: 0}}, set: {c_mktsegment: "DEBT"}) { c_custkey } }', "customer", "", f"select {C.replace('c_mktsegment', chr(39) + 'DEBT' + chr(39) + ' as c_mktsegment')} from customer where c_acctbal < 0 union all select {C} from customer where not coalesce(c_acctbal < 0, false)")
returned("gql_update_returning", 'mutation { updateCustomer(where: {c_acctbal: {lt: -900}}, set: {c_acctbal: 0}) { c_custkey c_acctbal } }', "updateCustomer", "c_custkey long, c_acctbal double", "select c_custkey, 0::double as c_acctbal from customer where c_acctbal < -900")
after("gql_update_by_pk", 'mutation { updateCustomerByPk(c_custkey: 12, set: {c_name: "Renamed"}) { c_custkey } }', "customer", "select=c_custkey,c_name", "select c_custkey, case when c_custkey = 12 then 'Renamed' else c_name end as c_name from customer")
after("gql_delete", 'mutation { deleteEvents(where: {event_type: {eq: "click"}}) { event_id } }', "events", "select=event_id,event_type", "select event_id, event_type from events where event_type <> 'click'")
after("gql_delete_by_pk", "mutation { deleteEventByPk(event_id: 17) { event_id } }", "events", "select=event_id", "select event_id from events where event_id <> 17")
after("gql_on_conflict_merge", 'mutation { insertRegion(objects: [{r_regionkey: 0, r_name: "SOUTH"}, {r_regionkey: 50, r_name: "NEW"}], onConflict: {update_columns: ["r_name"]}) { r_regionkey } }', "region", "", "select r_regionkey, case when r_regionkey = 0 then 'SOUTH' else r_name end as r_name from region union all select 50, 'NEW'")
after("gql_on_conflict_ignore", 'mutation { insertRegion(objects: [{r_regionkey: 0, r_name: "SOUTH"}, {r_regionkey: 50, r_name: "NEW"}], onConflict: {update_columns: []}) { r_regionkey } }', "region", "", "select r_regionkey, r_name from region union all select 50, 'NEW'")

REFUSED = {
    "update without where": ('mutation { updateCustomer(set: {c_acctbal: 1}) { c_custkey } }', "invalid_request"),
    "update with an empty where": ('mutation { updateCustomer(where: {}, set: {c_acctbal: 1}) { c_custkey } }', "invalid_request"),
    "update of nothing": ('mutation { updateCustomer(where: {c_custkey: {eq: 1}}, set: {}) { c_custkey } }', "invalid_request"),
    "delete without where": ("mutation { deleteEvents { event_id } }", "invalid_request"),
    "delete with an empty where": ("mutation { deleteEvents(where: {}) { event_id } }", "invalid_request"),
    "insert of nothing": ("mutation { insertRegion(objects: []) { r_regionkey } }", "invalid_request"),
    "unknown operator": ("{ customer(filter: {c_acctbal: {near: 3}}) { c_custkey } }", "invalid_request"),
    "in without a list": ("{ customer(filter: {c_custkey: {in: 3}}) { c_custkey } }", "invalid_request"),
    "unknown field": ("{ customer { nope } }", "column_not_found"),
    "repeated key": ('mutation { insertRegionOne(objects: {r_regionkey: 0, r_name: "AGAIN"}) { r_regionkey } }', "unique_violation"),
    "missing key": ('mutation { insertRegionOne(objects: {r_name: "NONE"}) { r_name } }', "not_null_violation"),
    "key that others refer to": ("mutation { deleteRegionByPk(r_regionkey: 1) { r_regionkey } }", "foreign_key_violation"),
}


@frame("gql_refusals", values([(k, c) for k, (_, c) in REFUSED.items()], "what, code"))
def gql_refusals(spark, sf_dir):
    e = engine(spark, sf_dir)
    return spark.createDataFrame([(k, e.graphql(doc)["errors"][0]["code"]) for k, (doc, _) in REFUSED.items()], "what string, code string")


def request(name: str, sql: str, table: str, query: str, *calls: tuple, key: str = "", **changed) -> None:
    """A table after requests (method, path, query, headers, body), each of which must succeed."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir, **changed)
        for method, path, q, headers, body in calls:
            r = e.request(method, path, q, headers, body)
            if r.status >= 300:
                raise ApiError("bad_request", "request", r.text())
        return e.frame(table, query)

    frame(name, sql)(run)


R = "select r_regionkey, r_name from region"
FORM, CSV = {"Content-Type": "application/x-www-form-urlencoded"}, {"Content-Type": "text/csv"}
request("body_json_object", f"{R} union all select 60, 'ONE'", "region", "", ("POST", "/region", "", {}, '{"r_regionkey": 60, "r_name": "ONE"}'))
request("body_json_array", f"{R} union all select 60, 'ONE' union all select 61, null", "region", "", ("POST", "/region", "", {}, '[{"r_regionkey": 60, "r_name": "ONE"}, {"r_regionkey": 61}]'))
request("body_form", f"{R} union all select 62, 'TWO WORDS & MORE'", "region", "", ("POST", "/region", "", FORM, "r_regionkey=62&r_name=TWO+WORDS+%26+MORE"))
request("body_csv", f"{R} union all select 63, 'A,B' union all select 64, null", "region", "", ("POST", "/region", "", CSV, 'r_regionkey,r_name\n63,"A,B"\n64,\n'))
request("body_columns", f"{R} union all select 65, null", "region", "", ("POST", "/region", "columns=r_regionkey", {}, '{"r_regionkey": 65, "r_name": "LEFT OUT"}'))
request("put_by_key", "select r_regionkey, case when r_regionkey = 2 then 'PUT' else r_name end as r_name from region", "region", "", ("PUT", "/region", "r_regionkey=eq.2", {}, '{"r_regionkey": 2, "r_name": "PUT"}'))
request("patch_logic_tree", "select p_partkey, case when p_size < 3 or (p_size > 48 and p_name like 'red%') then 0 else p_retailprice end as p_retailprice from part", "part", "select=p_partkey,p_retailprice", ("PATCH", "/part", "or=(p_size.lt.3,and(p_size.gt.48,p_name.like.red*))", {}, '{"p_retailprice": 0}'))
request("tx_rollback", R, "region", "", ("PATCH", "/region", "", {"Prefer": "tx=rollback"}, '{"r_name": "GONE"}'))
request("several_commits", "select r_regionkey, 'B' as r_name from region where r_regionkey <> 70 union all select 70, 'B'", "region", "", ("POST", "/region", "", {}, '{"r_regionkey": 70, "r_name": "A"}'), ("PATCH", "/region", "", {}, '{"r_name": "A"}'), ("PATCH", "/region", "r_name=eq.A", {}, '{"r_name": "B"}'))

TRIES = [
    ("a reference to nothing", "POST", "/nation", "", {}, {"n_nationkey": 99, "n_name": "X", "n_regionkey": 77}, 409, "foreign_key_violation"),
    ("a key that exists", "POST", "/nation", "", {}, {"n_nationkey": 1, "n_name": "X"}, 409, "unique_violation"),
    ("no key", "POST", "/nation", "", {}, {"n_name": "X"}, 409, "not_null_violation"),
    ("a row that others need", "DELETE", "/nation", "n_nationkey=eq.1", {}, None, 409, "foreign_key_violation"),
    ("a key that others need", "PATCH", "/nation", "n_nationkey=eq.1", {}, {"n_nationkey": 400}, 409, "foreign_key_violation"),
    ("an unknown column", "POST", "/nation", "", {}, {"nope": 1}, 404, "column_not_found"),
    ("a bad value", "PATCH", "/nation", "n_nationkey=eq.1", {}, {"n_regionkey": "many"}, 400, "invalid_request"),
    ("too many rows", "PATCH", "/nation", "", {"Prefer": "max-affected=3"}, {"n_name": "X"}, 400, "invalid_request"),
    ("nothing to set", "PATCH", "/nation", "", {}, {}, 400, "invalid_request"),
    ("nothing to insert", "POST", "/nation", "", {}, [], 400, "invalid_request"),
]


@frame("constraint_violations", values([(t[0], t[6], t[7]) for t in TRIES], "what, status, code"))
def constraint_violations(spark, sf_dir):
    e = engine(spark, sf_dir)
    got = [(t[0], e.request(t[1], t[2], t[3], t[4], None if t[5] is None else json.dumps(t[5]))) for t in TRIES]
    return spark.createDataFrame([(what, r.status, r.body["code"]) for what, r in got], TOLD)


@frame("insert_defaults", "select 901 as c_custkey, 'NEW' as c_mktsegment, 1.5::double as c_acctbal union all select 902, 'OWN', 1.5 union all select 903, null, null")
def insert_defaults(spark, sf_dir):
    """missing=default fills what a row leaves out; missing=null does not, where another row has the column."""
    from dataclasses import replace

    cat = catalog(spark, sf_dir)
    t = cat.table("customer")
    cols = tuple(replace(c, default={"c_mktsegment": "NEW", "c_acctbal": 1.5}.get(c.name)) for c in t.columns)
    e = Engine(spark, replace(cat, tables=cat.tables | {t.name: replace(t, columns=cols)}))
    top = scan(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    e.request("POST", "/customer", "", {"Prefer": "missing=default"}, json.dumps([{"c_custkey": top + 901}, {"c_custkey": top + 902, "c_mktsegment": "OWN"}]))
    e.request("POST", "/customer", "", {"Prefer": "missing=null"}, json.dumps([{"c_custkey": top + 903}, {"c_custkey": top + 904, "c_mktsegment": "X", "c_acctbal": 2}]))
    return e.frame("customer").where(f"c_custkey > {top} and c_custkey < {top + 904}").select((F.col("c_custkey") - top).cast("int").alias("c_custkey"), "c_mktsegment", "c_acctbal")


@frame("insert_builder", f"{R} union all select 80, 'A' union all select 81, 'B' union all select -1, 'NONE'")
def insert_builder(spark, sf_dir):
    return Insert(scan(spark, sf_dir, "region"), {"r_regionkey": -1, "r_name": "NONE"}).values(r_regionkey=80, r_name="A").values(r_regionkey=81, r_name="B").default_values().build()[0]


@frame("update_builder", "select n_nationkey, 'SOME' as n_name, n_regionkey + 1 as n_regionkey from nation where n_regionkey = 2 and n_nationkey > 5")
def update_builder(spark, sf_dir):
    return Update(scan(spark, sf_dir, "nation")).set("n_name", "SOME").set_raw("n_regionkey", "n_regionkey + 1").where("n_regionkey = 2").where(F.col("n_nationkey") > 5).build()[1]


@frame("returning_keys_or_all", "select 'all' as what, 0 as n_nationkey, count(*)::int as n_columns from (select unnest(['n_nationkey', 'n_name', 'n_regionkey'])) union all select 'picked', 0, 2")
def returning_keys_or_all(spark, sf_dir):
    e, prefer = engine(spark, sf_dir), {"Prefer": "return=representation"}
    body = '{"n_name": "X"}'
    out = [("all", e.request("PATCH", "/nation", "n_nationkey=eq.0", prefer, body).body), ("picked", e.request("PATCH", "/nation", "n_nationkey=eq.0&select=n_nationkey,n_name", prefer, body).body)]
    return spark.createDataFrame([(what, rows[0]["n_nationkey"], len(rows[0])) for what, rows in out], "what string, n_nationkey int, n_columns int")


def _guarded(spark, sf_dir) -> Engine:
    c, e = Name("public", "customer"), Name("public", "events")
    mine = lambda ctx: F.col("c_nationkey") == ctx.claims["nation"]
    rules = (Policy(c, ("agent",), "select", mine), Policy(c, ("agent",), "update", mine, lambda ctx: mine(ctx) & (F.col("c_acctbal") >= 0)), Policy(c, ("agent",), "insert", lambda ctx: F.lit(True)))
    grants = {("agent", c): frozenset({"select", "insert", "update"}), ("agent", e): frozenset({"select"}), ("clerk", c): frozenset({"select", "insert"})}
    return engine(spark, sf_dir, policies=rules, grants=grants)


AGENT = Context("agent", {"nation": 3})


@frame("rls_update", f"select {C} from customer where c_nationkey <> 3 or c_nationkey is null union all select c_custkey, c_name, c_nationkey, 7.0::double, c_mktsegment from customer where c_nationkey = 3")
def rls_update(spark, sf_dir):
    """An update reaches the rows of the role's policy and no others."""
    e = _guarded(spark, sf_dir)
    if e.request("PATCH", "/customer", "", {}, '{"c_acctbal": 7}', AGENT).status != 204:
        raise ApiError("bad_request", "request", "the update failed")
    return e.store.rows(e.catalog.table("customer"))


GUARDED = [
    ("upsert of another's row", "POST", "/customer", {"Prefer": "resolution=merge-duplicates"}, {"nation": 4}, AGENT, 403, "row_policy"),
    ("upsert without the update grant", "POST", "/customer", {"Prefer": "resolution=merge-duplicates"}, {"nation": 4}, Context("clerk"), 403, "insufficient_privilege"),
    ("update out of the policy", "PATCH", "/customer", {}, {"set": {"c_nationkey": 4}}, AGENT, 403, "row_policy"),
    ("update against the check", "PATCH", "/customer", {}, {"set": {"c_acctbal": -1}}, AGENT, 403, "row_policy"),
    ("delete without a grant", "DELETE", "/events", {}, {}, AGENT, 403, "insufficient_privilege"),
    ("read without a grant", "GET", "/orders", {}, {}, AGENT, 403, "insufficient_privilege"),
]


@frame("rls_refusals", values([(g[0], g[6], g[7]) for g in GUARDED], "what, status, code"))
def rls_refusals(spark, sf_dir):
    e = _guarded(spark, sf_dir)
    other = scan(spark, sf_dir, "customer").where("c_nationkey = 4").agg(F.min("c_custkey")).first()[0]
    out = []
    for what, method, path, headers, how, ctx, _, _ in GUARDED:
        body = how.get("set") or ({"c_custkey": other, "c_name": "Taken", "c_nationkey": 3, "c_acctbal": 1} if "nation" in how else None)
        r = e.request(method, path, "", headers, json.dumps(body) if body else None, ctx)
        out.append((what, r.status, r.body["code"]))
    return spark.createDataFrame(out, TOLD)


@frame("rls_returning", "select c_custkey from customer where c_nationkey = 3 and c_acctbal >= 0")
def rls_returning(spark, sf_dir):
    """What an update gives back is what the role may see."""
    got = _guarded(spark, sf_dir).request("PATCH", "/customer", "select=c_custkey&c_acctbal=gte.0", {"Prefer": "return=representation"}, '{"c_mktsegment": "SEEN"}', AGENT)
    return spark.createDataFrame([(r["c_custkey"],) for r in got.body], "c_custkey long")
