"""A small shop and blog: tables, keys, policies and routines for the tests."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import Catalog, Name, Policy, foreign_key, many_to_many, table_of
from larkspur.operators.routines import routine

DAY = dt.datetime(2024, 3, 1, 9, 30)


def frames(spark):
    users = [(i, n, f"{n.split()[0].lower()}@mail.test", r, s, m, DAY) for i, (n, r, s, m) in enumerate(
        [("Ada Stone", "admin", "active", '{"tier": 1, "tags": ["a", "b"]}'), ("Ben Hill", "user", "active", '{"tier": 2}'), ("Cai Brook", "user", "active", "{}"), ("Dee Marsh", "user", "active", '{"tier": 2, "x": {"y": null, "z": [1, {"q": 5}]}}'), ("Eli Wood", "user", "inactive", "{}"),
         ("Fay Lake", "user", "active", "{}"), ("Gus Field", "user", "active", "{}"), ("Hal Moor", "user", "pending", "{}"), ("Ivy Glen", "admin", "active", "{}"), ("Jon Dale", "user", "active", "{}")], 1)]
    posts = [(i, u, t, s, g, p) for i, (u, t, s, g, p) in enumerate(
        [(1, "Learning Spark", "published", ["spark", "sql"], DAY), (1, "On joins", "published", ["sql"], DAY), (2, "Windows, and doors", "published", [], DAY), (3, "A walk", "published", ["life"], DAY), (2, "Draft one", "draft", ["sql", "draft"], None),
         (4, "Quick notes", "published", ["spark"], DAY), (6, "Notes on \"quotes\"", "published", None, DAY), (7, "More notes", "published", ["life"], DAY), (9, "Release", "published", ["news"], DAY), (3, "Draft two", "draft", [], None)], 1)]
    comments = [(i, (i - 1) % 8 + 1, None if i == 10 else i, f"comment {i}") for i in range(1, 11)]
    categories = [(1, "Tech", None), (2, "Data", 1), (3, "Life", None), (4, "Spark", 2)]
    links = [(1, 1), (1, 4), (2, 2), (3, 3), (7, 1), (7, 3)]
    products = [(1, "Spark book", "Books", D("39.90"), 150, True), (2, "Laptop", "Tech", D("999.00"), 100, True), (3, "Atlas", "Books", D("55.00"), 60, True), (4, "Mug", "Home", D("9.99"), 70, True), (5, "Phone", "Tech", D("599.50"), 200, True),
                (6, "Lamp", "Home", D("49.00"), 0, False), (7, "Novel", "Books", D("14.50"), 80, True), (8, "Screen", "Tech", D("249.00"), 120, True), (9, "Desk mat", "Home", D("19.00"), 500, True), (10, "Pen", "Office", D("12.25"), 900, True)]
    make = spark.createDataFrame
    return {
        "users": make(users, "id int, name string, email string, role string, status string, metadata string, created_at timestamp_ntz"),
        "posts": make(posts, "id int, user_id int, title string, status string, tags array<string>, published_at timestamp_ntz"),
        "comments": make(comments, "id int, post_id int, user_id int, content string"),
        "categories": make(categories, "id int, name string, parent_id int"),
        "post_categories": make(links, "post_id int, category_id int"),
        "products": make(products, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("price", T.DecimalType(10, 2)), T.StructField("stock", T.IntegerType()), T.StructField("is_active", T.BooleanType())])),
    }


def catalog(spark):
    fs = frames(spark)
    t = lambda n, **kw: table_of(fs[n], n, **({"pk": ("id",)} | kw))
    tables = [
        t("users", json=("metadata",), defaults={"role": "user", "status": "active", "metadata": "{}"}, required=("name", "email"), auto=("id",)),
        t("posts", defaults={"status": "draft"}, required=("title",), auto=("id",)),
        t("comments"), t("categories"), t("post_categories", pk=("post_id", "category_id")), t("products", required=("name", "price"), defaults={"stock": 0, "is_active": True}),
    ]
    active = table_of(fs["users"].where("status = 'active'").select("id", "name"), "active_users", is_view=True, insertable=False, updatable=False, deletable=False)
    other = table_of(fs["users"].select("id", "name"), "users", pk=("id",), schema="api")
    links = [
        *foreign_key("posts_user", "posts", ["user_id"], "users", ["id"]), *foreign_key("comments_post", "comments", ["post_id"], "posts", ["id"]), *foreign_key("comments_user", "comments", ["user_id"], "users", ["id"]),
        *foreign_key("categories_parent", "categories", ["parent_id"], "categories", ["id"]), *many_to_many("post_categories", ("posts", "id", "post_id"), ("categories", "id", "category_id")),
    ]
    users, posts = Name("public", "users"), Name("public", "posts")
    policies = (
        Policy(users, ("anon",), "select", lambda c: F.col("status") == "active"),
        Policy(users, ("member",), "select", lambda c: F.lit(True)),
        Policy(users, ("member",), "update", lambda c: F.col("id") == c.claims["sub"]),
        Policy(users, ("admin",), "all", lambda c: F.lit(True)),
    )

    def get_user(spark, user_id: int):
        return fs["users"].where(F.col("id") == user_id)

    def get_user_named(spark, user_name: str):
        return fs["users"].where(F.col("name") == user_name)

    def stats(spark):
        return fs["users"].agg(F.count("*").alias("total_users"), F.count_if(F.col("status") == "active").alias("active_users"))

    def echo(spark, message: str):
        return message

    def touch(spark, n: int):
        return n + 1

    routines = (
        routine("get_user", get_user), routine("get_user", get_user_named), routine("stats", stats, "table"),
        routine("echo", echo, "scalar", composite=False), routine("touch", touch, "scalar", "volatile", composite=False),
    )
    return Catalog({x.name: x for x in [*tables, active, other]}, tuple(links), routines, policies, None, ("public", "api"))
