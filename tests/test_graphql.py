from decimal import Decimal as D

import pytest

from larkspur.catalog import Catalog, Name, foreign_key, table_of
from larkspur.engine import Engine
from larkspur.graphql.parser import parse
from larkspur.graphql.schema import build


def catalog(spark):
    make = spark.createDataFrame
    widgets = make([(1, "alpha", "books", D("10.50"), 5, True), (2, "bravo", "tools", D("20.00"), 0, True), (3, "charlie", "books", D("30.25"), 12, False), (4, "delta", "tools", None, 7, True)], "id int, name string, category string, price decimal(10,2), stock int, is_active boolean")
    authors = make([(1, "ada"), (2, "grace"), (3, "lonely")], "id int, name string")
    books = make([(1, "a-one", 1), (2, "a-two", 1), (3, "g-one", 2)], "id int, title string, author_id int")
    chapters = make([(1, "a-one-c1", 1), (2, "a-one-c2", 1), (3, "g-one-c1", 3)], "id int, heading string, book_id int")
    other = make([(1, "other")], "id int, marker string")
    tables = [table_of(widgets, "widgets", ("id",), required=("name",), defaults={"is_active": True}), table_of(authors, "authors", ("id",)), table_of(books, "books", ("id",)), table_of(chapters, "chapters", ("id",)), table_of(other, "widgets", ("id",), schema="alt")]
    links = [*foreign_key("books_author", "books", ["author_id"], "authors", ["id"]), *foreign_key("chapters_book", "chapters", ["book_id"], "books", ["id"])]
    return Catalog({t.name: t for t in tables}, tuple(links), schemas=("public", "alt"))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, catalog(spark))


@pytest.fixture
def fresh(spark):
    return Engine(spark, catalog(spark))


def data(engine, doc, **variables):
    r = engine.graphql(doc, variables)
    assert "errors" not in r, r
    return r["data"]


def ids(engine, args):
    return [w["id"] for w in data(engine, "{ widgets(%s) { id } }" % args)["widgets"]]


@pytest.mark.parametrize(
    "args, want",
    [
        ('filter: {category: {eq: "books"}}, orderBy: ["id.asc"]', [1, 3]),
        ('filter: {stock: {gt: 5}}, orderBy: ["id.asc"]', [3, 4]),
        ('orderBy: ["stock.asc"]', [2, 1, 4, 3]),
        ('orderBy: "stock_DESC", limit: 1', [3]),
        ('orderBy: ["id.asc"], limit: 2, offset: 1', [2, 3]),
        ('filter: {id: {in: [1, 4]}}, orderBy: ["id.asc"]', [1, 4]),
        ("filter: {id: {in: []}}", []),
        ("filter: {price: {isNull: true}}", [4]),
        ('filter: {price: {isNull: false}}, orderBy: ["id.asc"]', [1, 2, 3]),
        ('filter: {or: [{id: {eq: 1}}, {name: {like: "ch%"}}]}, orderBy: ["id.asc"]', [1, 3]),
        ('filter: {_not: {category: "books"}}, orderBy: ["id.asc"]', [2, 4]),
        ('filter: {stock: {gte: 5, lt: 12}}, orderBy: ["id.asc"]', [1, 4]),
        ('filter: {name: {_ilike: "A%"}}', [1]),
        ('filter: {name: {contains: "har"}}', [3]),
        ("filter: {is_active: false}", [3]),
    ],
)
def test_lists(engine, args, want):
    assert ids(engine, args) == want


@pytest.mark.parametrize("doc", ['{ widgets(orderBy: ["nope.asc"]) { id } }', '{ widgets(orderBy: ["id.sideways"]) { id } }', "{ widgets(filter: {id: {near: 3}}) { id } }", "{ widgets(filter: {id: {in: 3}}) { id } }", "{ widgets { nope } }", "{ nothing { id } }", "{ widgets(limit: -1) { id } }"])
def test_errors(engine, doc):
    r = engine.graphql(doc)
    assert r["errors"] and list(r["data"].values()) == [None]


def test_one_failure_leaves_the_rest(engine):
    r = engine.graphql("{ good: authors { id } bad: widgets { nope } }")
    assert len(r["data"]["good"]) == 3 and r["data"]["bad"] is None and r["errors"][0]["path"] == ["bad"]


def test_by_pk_and_cap(engine):
    assert data(engine, "{ widgetByPk(id: 3) { name price } }") == {"widgetByPk": {"name": "charlie", "price": 30.25}}
    assert data(engine, "{ widgetByPk(id: 30) { name } }") == {"widgetByPk": None}
    assert [w["id"] for w in Engine(engine.spark, engine.catalog, max_rows=2).graphql('{ widgets(orderBy: ["id.asc"]) { id } }')["data"]["widgets"]] == [1, 2]


def test_embeds(engine):
    got = data(engine, '{ authors(orderBy: ["id.asc"]) { name books { title chapters { heading } } } }')["authors"]
    assert [len(a["books"]) for a in got] == [2, 1, 0]
    assert got[0]["books"][0] == {"title": "a-one", "chapters": [{"heading": "a-one-c1"}, {"heading": "a-one-c2"}]}
    assert [b["author"]["name"] for b in data(engine, '{ books(orderBy: ["id.asc"]) { author { name } } }')["books"]] == ["ada", "ada", "grace"]
    assert data(engine, "{ authorByPk(id: 1) { books(limit: 1, orderBy: [\"id.desc\"]) { id } } }")["authorByPk"] == {"books": [{"id": 2}]}


def test_documents(engine):
    doc = """query one($id: Int!, $more: Boolean = false) { ...f } query two { authors { id } }
    fragment f on Query { w: widgetByPk(id: $id) { id ... on Widget { name } stock @include(if: $more) } }"""
    assert engine.graphql(doc, {"id": 2}, operation="one")["data"] == {"w": {"id": 2, "name": "bravo"}}
    assert engine.graphql(doc, {}, operation="one")["errors"]
    assert engine.graphql("{ widgets { id }")["errors"]
    kind, fields = parse('{ a(x: {y: [1, 2.5, "s\\n\\u00e9", true, null, ENUM]}) { b } }', {})
    assert fields[0].args == {"x": {"y": [1, 2.5, "s\né", True, None, "ENUM"]}}


def test_mutations(fresh):
    assert data(fresh, 'mutation { updateWidgets(where: {id: {eq: 2}}, set: {name: "renamed"}) { id name } }')["updateWidgets"] == [{"id": 2, "name": "renamed"}]
    assert [w["name"] for w in data(fresh, '{ widgets(orderBy: ["id.asc"]) { name } }')["widgets"]] == ["alpha", "renamed", "charlie", "delta"]
    for doc in ("mutation { updateWidgets(set: {stock: 1}) { id } }", "mutation { updateWidgets(where: {}, set: {stock: 1}) { id } }", "mutation { deleteWidgets(where: {}) { id } }", "mutation { updateWidgets(where: {id: {eq: 1}}, set: {}) { id } }", "mutation { insertWidgets(objects: []) { id } }"):
        assert fresh.graphql(doc)["errors"], doc
    assert data(fresh, 'mutation { insertWidgetOne(objects: {id: 9, name: "new"}) { id is_active } }')["insertWidgetOne"] == {"id": 9, "is_active": True}
    assert fresh.graphql('mutation { insertWidgetOne(objects: {id: 9, name: "again"}) { id } }')["errors"][0]["code"] == "unique_violation"
    assert data(fresh, "mutation { updateWidgetByPk(id: 1, set: {stock: 99}) { stock } }")["updateWidgetByPk"] == {"stock": 99}
    assert data(fresh, "mutation { updateWidgetByPk(id: 77, set: {stock: 99}) { stock } }")["updateWidgetByPk"] is None
    assert data(fresh, "mutation { deleteWidgetByPk(id: 1) { id } }")["deleteWidgetByPk"] == {"id": 1}
    assert len(data(fresh, "mutation { deleteWidgets(where: {stock: {gte: 0}}) { id } }")["deleteWidgets"]) == 3
    assert ids(fresh, "limit: 9") == [9]


INTROSPECTION = """query IntrospectionQuery { __schema { queryType { name } mutationType { name } subscriptionType { name } types { ...FullType } directives { name description locations args { ...InputValue } } } }
fragment FullType on __Type { kind name description fields(includeDeprecated: true) { name description args { ...InputValue } type { ...TypeRef } isDeprecated deprecationReason } inputFields { ...InputValue } interfaces { ...TypeRef } enumValues(includeDeprecated: true) { name description isDeprecated deprecationReason } possibleTypes { ...TypeRef } }
fragment InputValue on __InputValue { name description type { ...TypeRef } defaultValue }
fragment TypeRef on __Type { kind name ofType { kind name ofType { kind name ofType { kind name ofType { kind name } } } } }"""


def test_introspection(engine):
    """The query that client tools send."""
    s = data(engine, INTROSPECTION)["__schema"]
    types = {t["name"]: t for t in s["types"]}
    assert (s["queryType"], s["mutationType"], s["subscriptionType"]) == ({"name": "Query"}, {"name": "Mutation"}, {"name": "Subscription"})
    fields = {f["name"]: f for f in types["Widget"]["fields"]}
    assert fields["name"]["type"] == {"kind": "NON_NULL", "name": None, "ofType": {"kind": "SCALAR", "name": "String", "ofType": None}}
    books = next(f for f in types["Author"]["fields"] if f["name"] == "books")
    assert books["type"]["ofType"]["ofType"]["ofType"]["name"] == "Book" and [a["name"] for a in books["args"]] == ["filter", "orderBy", "limit", "offset"]
    pk = next(f for f in types["Query"]["fields"] if f["name"] == "widgetByPk")
    assert pk["args"][0]["type"]["ofType"]["name"] == "Int" and types["Widget"]["inputFields"] is None
    assert data(engine, '{ __type(name: "Book") { kind fields { name } } }')["__type"]["kind"] == "OBJECT"
    assert data(engine, '{ __type(name: "Nothing") { kind } }')["__type"] is None


def test_subscription_documents(spark, engine, tmp_path):
    from larkspur.errors import ApiError
    from larkspur.streaming import changes

    folder = f"file://{tmp_path}/log"
    old = engine.frame("widgets")
    new = spark.createDataFrame([(1, "alpha", "books", D("10.50"), 50, True), (9, "nine", "tools", None, 90, True)], old.schema)
    changes.log(changes.capture(old, new, ["id"], "widgets"), folder)
    got = changes.drain(engine.subscribe("subscription { widgets(filter: {stock: {gte: 50}}) { id left: stock } }", folder), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [("INSERT", 9, 90), ("UPDATE", 1, 50)]
    assert got.columns == ["operation", "id", "left"]
    for doc in ("subscription { nothing { id } }", "{ widgets { id } }", "subscription { widgets { nope } }"):
        with pytest.raises(ApiError):
            engine.subscribe(doc, folder)


def test_names_around_lists(spark):
    e = Engine(spark, catalog(spark), list_prefix="all", list_suffix="List")
    assert len(data(e, "{ allAuthorsList { id } }")["allAuthorsList"]) == 3 and data(e, "{ authorByPk(id: 1) { id } }")["authorByPk"] == {"id": 1}


def test_schema(engine):
    s = build(engine.catalog)
    assert {"widgets", "widgetByPk", "altWidgets", "authors", "authorByPk"} <= set(s.queries)
    assert {"insertWidgets", "insertWidgetOne", "updateWidgets", "updateWidgetByPk", "deleteWidgets", "deleteWidgetByPk"} <= set(s.mutations)
    assert set(s.relations["Author"]) == {"books"} and set(s.relations["Book"]) == {"author", "chapters"}
    text = s.text()
    assert text == build(engine.catalog).text() and "name: String!" in text and "price: BigDecimal" in text
    assert Name("alt", "widgets") == s.queries["altWidgets"].table.name
