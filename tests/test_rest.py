import json

import pytest

from larkspur.catalog import Context
from larkspur.engine import Engine
from tests import shop

ADMIN = Context("admin")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, shop.catalog(spark))


@pytest.fixture
def writable(spark):
    return Engine(spark, shop.catalog(spark))


def get(engine, table, query="", ctx=None, **headers):
    return engine.request("GET", f"/{table}", query, {k.replace("_", "-"): v for k, v in headers.items()}, ctx=ctx)


def ids(engine, table, query, ctx=None, **headers):
    r = get(engine, table, query, ctx, **headers)
    assert r.status in (200, 206), r.body
    return [x["id"] for x in r.body]


@pytest.mark.parametrize(
    "query, want",
    [
        ("order=id.asc&offset=8", [9, 10]),
        ("order=id.asc&limit=2&offset=4", [5, 6]),
        ("order=id.desc&limit=2", [10, 9]),
        ("id=eq.4", [4]),
        ("category=eq.Books&order=id", [1, 3, 7]),
        ("is_active=eq.false", [6]),
        ("is_active=is.false", [6]),
        ("is_active=eq.off", [6]),
        ("price=gt.100&order=id", [2, 5, 8]),
        ("stock=gte.100&stock=lte.500&order=id", [1, 2, 5, 8, 9]),
        ("id=in.(1,3,5)&order=id", [1, 3, 5]),
        ("id=not.eq.4&order=id", [1, 2, 3, 5, 6, 7, 8, 9, 10]),
        ("price=not.gt.100&order=id", [1, 3, 4, 6, 7, 9, 10]),
        ("id=not.in.(1,2,3)&order=id", [4, 5, 6, 7, 8, 9, 10]),
        ("category=eq.Books&order=id.desc&limit=2", [7, 3]),
        ("order=price.asc&limit=1", [4]),
        ("name=like.*book", [1]),
        ("name=ilike.*BOOK", [1]),
        ("name=match.^(Mug|Pen)$&order=id", [4, 10]),
        ("name=imatch.^mug", [4]),
        ("id=eq(any).{2,4}&order=id", [2, 4]),
        ("name=like(all).{*e*,*k*}&order=id", [9]),
        ("or=(id.eq.1,and(category.eq.Tech,price.lt.300))&order=id", [1, 8]),
        ("not.or=(id.lt.9,name.eq.Pen)", [9]),
        ('or=(name.in.("Desk mat",Pen),name.eq."Mug")&order=id', [4, 9, 10]),
        ("category=eq.Books';DROP TABLE products", []),
        ("name=fts.book %26 !laptop", [1]),
    ],
)
def test_products(engine, query, want):
    assert ids(engine, "products", query) == want


def test_select_shapes(engine):
    assert list(get(engine, "products", "select=id,name&order=id.asc&limit=1").body[0]) == ["id", "name"]
    assert get(engine, "products", "select=price::text:p,id:key&id=eq.1").body == [{"key": 1, "p": "39.90"}]
    assert len(get(engine, "products", "limit=1000").body) == 10
    assert Engine(engine.spark, engine.catalog, key_order="select").request("GET", "/users", "select=status,name,id&limit=1").text().startswith('[{"status"')
    assert get(engine, "users", "select=status,name,id&limit=1").text().startswith('[{"id"')


@pytest.mark.parametrize("query, status", [("select=id,nope", 404), ("limit=not-a-number", 400), ("id=eq.abc", 400), ("id=bad.1", 400), ("select=id,nope(id)", 400), ("select=id)", 400), ("or=(id.eq.1", 400), ("price=is.maybe", 400), ("price=eq.1e", 400)])
def test_errors(engine, query, status):
    assert get(engine, "products", query).status == status
    assert get(engine, "missing").status == 404


def test_ranges_and_counts(engine):
    assert ids(engine, "products", "order=id", Range="0-2") == [1, 2, 3]
    assert ids(engine, "products", "order=id", Range="7-") == [8, 9, 10]
    assert ids(engine, "products", "order=id&limit=2", Range="0-9") == [1, 2]
    r = get(engine, "products", "limit=3", Prefer="count=exact")
    assert (r.status, r.headers["content-range"]) == (206, "0-2/10")
    assert get(engine, "products", "", Prefer="count=exact").headers["content-range"] == "0-9/10"
    assert get(engine, "products", "offset=20", Prefer="count=exact").status == 416
    assert int(get(engine, "products", "", Prefer="count=planned").headers["content-range"].split("/")[1]) > 0
    head = engine.request("HEAD", "/products", "", {"Prefer": "count=exact"})
    assert head.body is None and head.headers["content-range"] == "*/10"


@pytest.mark.parametrize("most, query, want", [(4, "order=id", [1, 2, 3, 4]), (3, "order=id&limit=1000", [1, 2, 3]), (100, "order=id&limit=2", [1, 2]), (5, "order=id&offset=8", [9, 10])])
def test_max_rows(engine, most, query, want):
    assert ids(Engine(engine.spark, engine.catalog, max_rows=most), "products", query) == want


def test_nulls(engine):
    assert ids(engine, "posts", "published_at=is.null&order=id") == [5, 10]
    assert 5 not in ids(engine, "posts", "published_at=not.is.null")
    assert ids(engine, "posts", "order=published_at.desc,id&limit=2") == [5, 10]
    assert ids(engine, "posts", "order=published_at.asc,id.desc&limit=1") == [9]
    assert ids(engine, "posts", "order=published_at.asc.nullsfirst,id&limit=2") == [5, 10]
    assert 10 in ids(engine, "comments", "user_id=isdistinct.3")


def test_arrays_and_json(engine):
    assert ids(engine, "posts", "tags=cs.{sql}&order=id") == [1, 2, 5]
    assert ids(engine, "posts", "tags=cd.{sql,spark}&order=id") == [1, 2, 3, 6, 10]
    assert ids(engine, "posts", "tags=ov.{life,news}&order=id") == [4, 8, 9]
    assert ids(engine, "posts", "tags=not.ov.{life,news}&order=id") == [1, 2, 3, 5, 6, 10]
    assert get(engine, "posts", "select=tags&id=eq.1").body == [{"tags": ["spark", "sql"]}]
    assert ids(engine, "users", "metadata->>tier=eq.2&order=id") == [2, 4]
    assert ids(engine, "users", 'metadata=cs.{"tier": 2}&order=id') == [2, 4]
    assert ids(engine, "users", 'metadata=cs.{"tags": ["b"]}') == [1]
    assert ids(engine, "users", 'metadata=cs.{"x": {"z": [{"q": 5}]}}') == [4]
    assert get(engine, "users", "select=metadata->x->z->>0:first&id=eq.4").body == [{"first": "1"}]
    assert get(engine, "users", "select=metadata&id=eq.2").body == [{"metadata": {"tier": 2}}]


def test_embeds(engine):
    r = get(engine, "users", "select=id,name,posts(id,title)&order=id.asc&limit=2").body
    assert r[0]["posts"] == [{"id": 1, "title": "Learning Spark"}, {"id": 2, "title": "On joins"}]
    assert get(engine, "posts", "select=id,users(name)&order=id&limit=1").body == [{"id": 1, "users": {"name": "Ada Stone"}}]
    nested = get(engine, "users", "select=id,posts(id,comments(id))&id=eq.1").body
    assert nested == [{"id": 1, "posts": [{"id": 1, "comments": [{"id": 1}, {"id": 9}]}, {"id": 2, "comments": [{"id": 2}, {"id": 10}]}]}]
    assert list(get(engine, "users", "select=name,posts(id)&limit=1").body[0]) == ["name", "posts"]
    assert {"id": 10, "posts": []} in get(engine, "users", "select=id,posts(id)&order=id.desc").body
    assert get(engine, "comments", "select=id,users(name)&id=eq.10").body == [{"id": 10, "users": None}]
    assert get(engine, "posts", "select=id,categories(name)&id=eq.7").body == [{"categories": [{"name": "Tech"}, {"name": "Life"}], "id": 7}]
    assert get(engine, "posts", "select=id,...users(name:author)&id=eq.4").body == [{"author": "Cai Brook", "id": 4}]
    assert get(engine, "posts", "select=id,writer:x&id=eq.4").status == 404
    assert get(engine, "posts", "select=id,users:writer(name)&id=eq.4").body == [{"id": 4, "writer": {"name": "Cai Brook"}}]
    assert get(engine, "users", "select=id,...posts(id)").status == 400


def test_embed_filters(engine):
    assert [x["id"] for x in get(engine, "users", "select=id,posts!inner(id)&posts.status=eq.draft&order=id").body] == [2, 3]
    outer = get(engine, "users", "select=id,posts(id)&posts.status=eq.draft&order=id&limit=2").body
    assert outer == [{"id": 1, "posts": []}, {"id": 2, "posts": [{"id": 5}]}]
    capped = get(engine, "users", "select=id,posts(id)&posts.order=id.desc&posts.limit=1&id=eq.1").body
    assert capped == [{"id": 1, "posts": [{"id": 2}]}]
    assert get(Engine(engine.spark, engine.catalog, max_rows=1), "users", "select=id,posts(id)&order=id").body == [{"id": 1, "posts": [{"id": 1}]}]
    assert ids(engine, "users", "posts=is.null&order=id") == [10]
    assert ids(engine, "posts", "order=users(name).desc,id&limit=2") == [9, 8]
    self_ = get(engine, "categories", "select=id,categories!parent_id(id)&id=eq.1")
    assert self_.status in (200, 400)
    assert get(engine, "categories", "select=id,categories_parent(name)&id=eq.2").status in (200, 400)


def test_aggregates(engine):
    r = get(engine, "products", "select=category,count():n,sum(stock):stock,max(price)&order=category&having=(n.gte.3)").body
    assert r == [{"category": "Books", "max": 55.0, "n": 3, "stock": 290}, {"category": "Home", "max": 49.0, "n": 3, "stock": 570}, {"category": "Tech", "max": 999.0, "n": 3, "stock": 420}]
    assert get(engine, "products", "select=avg(stock)::int:mean").body == [{"mean": 218}]
    assert len(get(engine, "products", "select=category&distinct=true").body) == 4


def test_policies(engine):
    assert {x["status"] for x in get(engine, "users", "select=id,status").body} == {"active"}
    assert len(get(engine, "users", "", Context("member", {"sub": 2})).body) == 10
    assert get(engine, "users", "", Context("nobody")).body == []
    assert get(engine, "posts", "select=id,users(name)&user_id=eq.5").body == []


def test_schemas_and_info(engine):
    assert list(get(engine, "users", "limit=1", ctx=ADMIN, Accept_Profile="api").body[0]) == ["id", "name"]
    assert get(engine, "users", Accept_Profile="hidden").status == 406
    assert engine.request("OPTIONS", "/active_users").headers["allow"] == "OPTIONS,GET,HEAD"
    assert {"schema": "public", "name": "active_users", "kind": "view"} in engine.request("GET", "/").body
    assert len(get(engine, "active_users").body) == 8
    assert engine.request("TRACE", "/users").status == 405


def test_media(engine):
    assert get(engine, "products", "select=id,name&id=in.(3,4)&order=id", Accept="text/csv").text() == "id,name\n3,Atlas\n4,Mug\n"
    one = "application/vnd.larkspur.object+json"
    assert get(engine, "products", "select=id&id=eq.3", Accept=one).body == {"id": 3}
    assert get(engine, "products", "select=id&id=eq.99", Accept=one).status == 404
    assert get(engine, "products", "select=id", Accept=one).status == 406
    assert get(engine, "products", "select=id&id=eq.99", Accept=one + ";nulls=null").body is None
    assert get(engine, "posts", "select=id,published_at&id=eq.5", Accept="application/vnd.larkspur.array+json;nulls=stripped").body == [{"id": 5}]
    assert "Scan" in get(engine, "products", "id=eq.1", Accept="application/vnd.larkspur.plan+text").body
    assert get(engine, "products", "", Accept="image/png").status == 406


def test_insert(writable):
    r = writable.request("POST", "/products", "", {"Prefer": "return=representation"}, json.dumps({"id": 11, "name": "Cup", "price": 5}))
    assert (r.status, r.body) == (201, [{"category": None, "id": 11, "is_active": True, "name": "Cup", "price": 5.0, "stock": 0}])
    assert ids(writable, "products", "id=gt.9&order=id") == [10, 11]
    assert writable.request("POST", "/products", "", {}, json.dumps({"id": 11, "name": "Cup", "price": 5})).status == 409
    assert writable.request("POST", "/products", "", {}, json.dumps({"id": 12, "price": 5})).status == 409
    assert writable.request("POST", "/products", "", {}, json.dumps({"id": 12, "nope": 5})).status == 404
    assert writable.request("POST", "/comments", "", {}, json.dumps({"id": 12, "post_id": 99})).status == 409
    assert writable.request("POST", "/active_users", "", {}, "{}").status == 405
    assert writable.request("POST", "/products", "", {}, "[]").status == 400
    r = writable.request("POST", "/products", "", {"Content-Type": "text/csv"}, "id,name,price\n20,A,1\n21,B,2\n")
    assert r.status == 201 and ids(writable, "products", "id=gte.20&order=id") == [20, 21]
    r = writable.request("POST", "/users", "select=id,role,status", {"Prefer": "return=representation,missing=default"}, json.dumps([{"name": "Kit", "email": "k@x"}, {"name": "Lou", "email": "l@x", "role": "admin"}]), ADMIN)
    assert r.body == [{"id": 11, "role": "user", "status": "active"}, {"id": 12, "role": "admin", "status": "active"}]
    assert writable.request("POST", "/users", "", {}, json.dumps({"name": "X", "email": "y"})).status == 403


def test_upsert(writable):
    body = json.dumps([{"id": 4, "name": "Big mug", "price": 12}, {"id": 30, "name": "Tray", "price": 3}])
    assert writable.request("POST", "/products", "", {"Prefer": "resolution=ignore-duplicates"}, body).status == 201
    assert get(writable, "products", "select=name&id=in.(4,30)&order=id").body == [{"name": "Mug"}, {"name": "Tray"}]
    assert writable.request("POST", "/products", "on_conflict=id", {"Prefer": "resolution=merge-duplicates"}, body).status == 201
    assert get(writable, "products", "select=name,stock&id=eq.4").body == [{"name": "Big mug", "stock": 70}]
    r = writable.request("PUT", "/products", "id=eq.4", {"Prefer": "return=representation"}, json.dumps({"id": 4, "name": "Mug", "price": 1}))
    assert (r.status, r.body[0]["stock"]) == (200, 70)


def test_update_and_delete(writable):
    r = writable.request("PATCH", "/products", "or=(id.eq.1,id.eq.2)&select=id,stock", {"Prefer": "return=representation"}, json.dumps({"stock": 7}))
    assert sorted(x["id"] for x in r.body) == [1, 2] and {x["stock"] for x in r.body} == {7}
    assert ids(writable, "products", "stock=eq.7&order=id") == [1, 2]
    assert writable.request("PATCH", "/products", "id=eq.1", {}, json.dumps({"stock": "many"})).status == 400
    assert writable.request("PATCH", "/products", "", {"Prefer": "max-affected=3"}, json.dumps({"stock": 1})).status == 400
    assert writable.request("PATCH", "/products", "id=eq.3", {"Prefer": "tx=rollback"}, json.dumps({"stock": 1})).status == 204
    assert get(writable, "products", "select=stock&id=eq.3").body == [{"stock": 60}]
    me = Context("member", {"sub": 2})
    r = writable.request("PATCH", "/users", "", {"Prefer": "return=representation"}, json.dumps({"role": "x"}), me)
    assert [x["id"] for x in r.body] == [2]
    assert writable.request("DELETE", "/products", "or=(id.eq.9,id.eq.10)", {"Prefer": "return=representation,count=exact"}).headers["content-range"] == "0-1/2"
    assert len(get(writable, "products").body) == 8
    assert writable.request("DELETE", "/posts", "published_at=gt.2030-01-01").status == 204
    assert len(get(writable, "posts").body) == 10  # a null condition deletes nothing
    assert writable.request("DELETE", "/products").status == 204 and get(writable, "products").body == []


def test_written_versions(spark, tmp_path):
    e = Engine(spark, shop.catalog(spark), folder=f"file://{tmp_path}")
    assert e.request("POST", "/categories", "", {}, json.dumps({"id": 9, "name": "New"})).status == 201
    assert e.request("DELETE", "/categories", "id=lt.3").status == 409  # other categories are below them
    assert e.request("DELETE", "/categories", "id=in.(3,4)").status == 204
    assert ids(e, "categories", "order=id") == [1, 2, 9]
    assert len(list(tmp_path.glob("public.categories/v*"))) == 2


def test_references_hold(writable):
    """A row that others refer to is neither deleted nor given another key."""
    r = writable.request("DELETE", "/users", "id=eq.1", {}, None, ADMIN)
    assert (r.status, r.body["code"]) == (409, "foreign_key_violation") and len(get(writable, "users", "", ADMIN).body) == 10
    assert writable.request("PATCH", "/users", "id=eq.1", {}, json.dumps({"id": 50}), ADMIN).status == 409
    assert writable.request("PATCH", "/users", "id=eq.1", {}, json.dumps({"name": "A. Stone"}), ADMIN).status == 204
    assert writable.request("DELETE", "/comments", "id=eq.1").status == 204
    assert writable.request("DELETE", "/users", "id=eq.5", {}, None, ADMIN).status == 409  # a comment
    assert writable.request("DELETE", "/comments", "user_id=eq.5").status == 204
    assert writable.request("DELETE", "/users", "id=eq.5", {}, None, ADMIN).status == 204
    assert writable.request("PATCH", "/categories", "id=eq.2", {}, json.dumps({"id": 20})).status == 409


def test_policies_of_writes(spark):
    """An upsert changes no row that an update could not; an update leaves no row outside its policy; what comes back is what may be seen."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from larkspur.catalog import Name, Policy

    users = Name("public", "users")
    cat = shop.catalog(spark)
    own = lambda c: F.col("id") == c.claims["sub"]
    rules = (
        Policy(users, ("member",), "select", own), Policy(users, ("member",), "insert", lambda c: F.lit(True)), Policy(users, ("member",), "update", own, lambda c: F.col("status") != "admin"),
        Policy(users, ("writer",), "insert", lambda c: F.lit(True)), Policy(users, ("writer",), "select", lambda c: F.lit(True)),
    )
    e = lambda: Engine(spark, replace(cat, policies=rules))
    me, body = Context("member", {"sub": 2}), lambda **kw: json.dumps({"email": "x@y", **kw})
    merge = {"Prefer": "resolution=merge-duplicates,return=representation"}
    for who in (me, Context("writer")):
        w = e()
        assert w.request("POST", "/users", "", merge, body(id=3, name="Taken"), who).status == 403
        assert w.request("PUT", "/users", "id=eq.3", {}, body(id=3, name="Taken"), who).status == 403
        assert w.store.written(w.catalog.table("users")) is None
    w = e()
    assert w.request("POST", "/users", "select=id,name", merge, body(id=2, name="Mine"), me).body == [{"id": 2, "name": "Mine"}]
    assert w.request("POST", "/users", "select=id", {"Prefer": "return=representation"}, body(id=77, name="Other"), me).body == []
    assert w.request("PATCH", "/users", "", {}, json.dumps({"status": "admin"}), me).status == 403
    assert w.request("PATCH", "/users", "id=eq.2", {"Prefer": "return=representation"}, json.dumps({"status": "away"}), me).body[0]["status"] == "away"
    grants = {("g", users): frozenset({"insert", "select"})}
    g = Engine(spark, replace(cat, policies=(), grants=grants))
    assert g.request("POST", "/users", "", merge, body(id=3, name="Taken"), Context("g")).status == 403
    assert g.request("POST", "/users", "", {}, body(id=90, name="New"), Context("g")).status == 201


def test_rpc(engine):
    call = lambda m, f, q="", b=None, **h: engine.request(m, f"/rpc/{f}", q, h, b)
    assert [x["name"] for x in call("GET", "get_user", "user_id=2&select=name").body] == ["Ben Hill"]
    assert [x["id"] for x in call("POST", "get_user", "", json.dumps({"user_name": "Ivy Glen"})).body] == [9]
    assert call("POST", "stats", "", "{}").body == [{"active_users": 8, "total_users": 10}]
    assert call("GET", "echo", "message=hi").body == [{"echo": "hi"}]
    assert call("POST", "touch", "", json.dumps({"n": "4"})).body == [{"touch": 5}]
    assert call("GET", "touch", "n=4").status == 405
    assert call("POST", "touch", "", json.dumps({"n": "x"})).status == 400
    assert call("POST", "get_user", "", json.dumps({"other": 1})).status == 404
    assert call("GET", "nothing").status == 404
    compat = Engine(engine.spark, engine.catalog, rpc_compat=True)
    assert compat.request("GET", "/rpc/echo", "message=hi").body == "hi"
    assert compat.request("GET", "/rpc/stats").body == {"total_users": 10, "active_users": 8}
    assert call("POST", "echo", "", b"raw text", **{"Content-Type": "text/plain"}).body == [{"echo": "raw text"}]
    assert [x["id"] for x in call("GET", "get_user", "user_name=Ada Stone&id=gt.0&order=id&limit=1").body] == [1]


def test_pushdown(spark):
    from larkspur import render
    from larkspur.sources.testdata import catalog

    e = Engine(spark, catalog(spark, "/root/testdata/sf0.001"))
    plan = render.explain(e.frame("orders", "select=o_orderkey&o_totalprice=gt.100000&o_orderstatus=eq.O"))
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "EqualTo(o_orderstatus,O)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    paged = render.explain(e.frame("orders", "select=o_orderkey,customer(c_name)&order=o_totalprice.desc,o_orderkey&limit=25"))
    assert "TakeOrderedAndProject" in paged and "CartesianProduct" not in paged
    two = e.frame("customer", "select=c_custkey,orders(o_orderkey,lineitem(l_partkey))&limit=5")
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "LocalRelation" in plan  # orders by the page, lines by the page's orders
    assert sum(len(o["lineitem"]) for r in two.collect() for o in r["orders"]) > 0
