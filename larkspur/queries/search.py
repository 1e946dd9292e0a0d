"""Full text, vectors, and routines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import vectors
from larkspur.operators import routines
from larkspur.queries import frame, rest
from larkspur.sources.testdata import scan

E = r"[^\p{L}\p{N}]"


def _has(*words: str) -> str:
    inside = f"{E}+".join(words)
    return f"regexp_matches(lower(text), '(^|{E}){inside}({E}|$)')"


rest("fts_boolean", "documents", "select=doc_id&text=fts.the %26 (and | ing) %26 !und", f"select doc_id from documents where {_has('the')} and ({_has('and')} or {_has('ing')}) and not {_has('und')}")
rest("fts_plain", "documents", "select=doc_id&text=plfts.and the of", f"select doc_id from documents where {_has('and')} and {_has('the')} and {_has('of')}")
rest("fts_phrase", "documents", "select=doc_id&text=phfts(english).of the", f"select doc_id from documents where {_has('of', 'the')}")
rest("fts_web", "documents", 'select=doc_id&text=wfts."in the" or licensed -the', f"select doc_id from documents where {_has('in', 'the')} or ({_has('licensed')} and not {_has('the')})")
rest("fts_prefix", "documents", "select=doc_id&text=fts.licens:*", f"select doc_id from documents where regexp_matches(lower(text), '(^|{E})licens')")

#: A fixed query vector of 64 dimensions.
Q = [round(math.sin(i + 1), 6) for i in range(64)]
QSQL = "[" + ", ".join(map(str, Q)) + "]::double[]"
V = "embedding::double[]"


def search_similar(spark: SparkSession, sf_dir: str, query: list[float], threshold: float, k: int) -> DataFrame:
    """Rows whose cosine similarity is over a threshold, best first."""
    df = scan(spark, sf_dir, "embeddings").withColumn("similarity", 1 - vectors.cosine(F.col("embedding"), query))
    return df.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "vec_id").limit(k).select("vec_id", F.round("similarity", 6).alias("similarity"))


def semantic_search(spark: SparkSession, sf_dir: str, query: list[float], k: int, distance: str = "cosine") -> DataFrame:
    out = vectors.nearest(scan(spark, sf_dir, "embeddings"), "embedding", query, k, "vec_id", distance)
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


def recommend(spark: SparkSession, sf_dir: str, vec_id: int, k: int) -> DataFrame:
    """The nearest to a stored vector, itself left out. The target is one row by its key."""
    df = scan(spark, sf_dir, "embeddings")
    target = df.where(F.col("vec_id") == vec_id).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).limit(1)
    return vectors.nearest_each(target, df, "embedding", "vec_id", k).select("vec_id", F.round("distance", 6).alias("distance"))


for _name, _kind, _sql in (("knn_l2", "l2", "list_distance"), ("knn_ip", "ip", "list_negative_inner_product"), ("knn_cosine", "cosine", "list_cosine_distance")):
    frame(_name, f"select vec_id, round({_sql}({V}, {QSQL}), 6) as distance from embeddings order by {_sql}({V}, {QSQL}), vec_id limit 10")(lambda spark, sf_dir, kind=_kind: semantic_search(spark, sf_dir, Q, 10, kind))
frame("similarity_threshold", f"select vec_id, round(1 - list_cosine_distance({V}, {QSQL}), 6) as similarity from embeddings where 1 - list_cosine_distance({V}, {QSQL}) > 0.1 order by 1 - list_cosine_distance({V}, {QSQL}) desc, vec_id limit 20")(lambda spark, sf_dir: search_similar(spark, sf_dir, Q, 0.1, 20))
frame("recommend", f"select e.vec_id, round(list_cosine_distance(e.{V}, t.{V}), 6) as distance from embeddings e, embeddings t where t.vec_id = 7 and e.vec_id <> 7 order by list_cosine_distance(e.{V}, t.{V}), e.vec_id limit 8")(lambda spark, sf_dir: recommend(spark, sf_dir, 7, 8))


def registry(sf_dir: str) -> list:
    """The routines of a data folder."""

    def get_customer(spark: SparkSession, id: int) -> DataFrame:
        return scan(spark, sf_dir, "customer").where(F.col("c_custkey") == id)

    def search_parts(spark: SparkSession, query: str, max_results: int = 10) -> DataFrame:
        return scan(spark, sf_dir, "part").where(F.col("p_name").ilike(f"%{query}%")).orderBy("p_partkey").limit(max_results)

    def order_stats(spark: SparkSession) -> DataFrame:
        o = scan(spark, sf_dir, "orders")
        return o.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))

    def order_total(spark: SparkSession, id: int) -> DataFrame:
        lines = scan(spark, sf_dir, "lineitem").where(F.col("l_orderkey") == id)
        return lines.agg(F.round(F.coalesce(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), F.lit(0.0)), 2).alias("order_total"))

    def customer_orders(spark: SparkSession, id: int) -> DataFrame:
        return scan(spark, sf_dir, "orders").where(F.col("o_custkey") == id).orderBy(F.desc("o_orderdate"), "o_orderkey")

    def nearest(spark: SparkSession, query: list[float], k: int = 5) -> DataFrame:
        return semantic_search(spark, sf_dir, query, k)

    return [routines.routine(f.__name__, f, "table" if f is order_stats else "scalar" if f is order_total else "setof") for f in (get_customer, search_parts, order_stats, order_total, customer_orders, nearest)]


def _call(name: str, args: dict):
    def run(spark, sf_dir):
        r, bound = routines.bind([r for r in registry(sf_dir) if r.name.name == name], args)
        return routines.call(spark, r, bound, True)

    return run


frame("rpc_get_by_id", "select * from customer where c_custkey = 17")(_call("get_customer", {"id": "17"}))
frame("rpc_search", "select * from part where p_name ilike '%red%' order by p_partkey limit 10")(_call("search_parts", {"query": "RED"}))
frame("rpc_stats", "select count(*) as total, count(*) filter (where o_orderstatus = 'O') as open, count(*) filter (where o_totalprice > 200000) as large from orders")(_call("order_stats", {}))
frame("rpc_order_total", "select round(coalesce(sum(l_quantity * l_extendedprice), 0), 2) as order_total from lineitem where l_orderkey = 42")(_call("order_total", {"id": 42}))
frame("rpc_child_rows", "select * from orders where o_custkey = 5")(_call("customer_orders", {"id": "5"}))
frame("rpc_vector_arg", f"select vec_id, round(list_cosine_distance({V}, {QSQL}), 6) as distance from embeddings order by list_cosine_distance({V}, {QSQL}), vec_id limit 4")(_call("nearest", {"query": Q, "k": 4}))
