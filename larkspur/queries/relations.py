"""Embeds, joins, and tests of relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import batched
from larkspur.operators.builder import Select
from larkspur.queries import frame, rest
from larkspur.sources.testdata import scan


def _keys(column: str, field: str):
    """A list column to its length and its keys in order."""
    return lambda df: df.select(*[c for c in df.columns if c != column], F.size(column).cast("long").alias("n"), F.array_join(F.transform(column, lambda x: x[field].cast("string")), ",").alias("keys"))


rest(
    "embed_to_many_flat",
    "customer",
    "select=c_custkey,orders(o_orderkey)",
    "select c_custkey, count(o_orderkey) as n, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as keys from customer left join orders on o_custkey = c_custkey group by 1",
    _keys("orders", "o_orderkey"),
)
rest(
    "embed_to_many_empty",
    "orders",
    "select=o_orderkey,lineitem(l_partkey,l_suppkey,l_linenumber)",
    "select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1",
    lambda df: df.select("o_orderkey", F.size("lineitem").cast("long").alias("n")),
)
rest(
    "embed_to_one",
    "orders",
    "select=o_orderkey,customer:buyer(c_name,c_mktsegment)&o_totalprice=gt.250000",
    "select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey where o_totalprice > 250000",
    lambda df: df.select("o_orderkey", "buyer.c_name", "buyer.c_mktsegment"),
)
rest(
    "embed_nested",
    "region",
    "select=r_name,nation(n_name,customer(c_custkey))",
    "select r_name, n_name, count(c_custkey) as customers from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2",
    lambda df: df.select("r_name", F.explode("nation").alias("n")).select("r_name", F.col("n.n_name").alias("n_name"), F.size("n.customer").cast("long").alias("customers")),
)
rest(
    "embed_siblings",
    "nation",
    "select=n_name,customer(c_custkey),supplier(s_suppkey),region(r_name)",
    "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers, r_name from nation join region on n_regionkey = r_regionkey",
    lambda df: df.select("n_name", F.size("customer").cast("long").alias("customers"), F.size("supplier").cast("long").alias("suppliers"), "region.r_name"),
)
rest(
    "embed_inner",
    "customer",
    "select=c_custkey,orders!inner(o_orderkey)&orders.o_totalprice=gt.380000",
    "select c_custkey, count(*) as n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as keys from customer join orders on o_custkey = c_custkey where o_totalprice > 380000 group by 1",
    _keys("orders", "o_orderkey"),
)
rest(
    "embed_filter",
    "customer",
    "select=c_custkey,orders(o_orderkey)&orders.o_orderstatus=eq.P",
    "select c_custkey, count(o_orderkey) as n, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as keys from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1",
    _keys("orders", "o_orderkey"),
)
rest(
    "embed_cap_per_parent",
    "customer",
    "select=c_custkey,orders(o_orderkey)&orders.order=o_totalprice.desc,o_orderkey&orders.limit=3",
    "select c_custkey, count(o_orderkey) as n, coalesce(string_agg(o_orderkey::varchar, ',' order by o_totalprice desc, o_orderkey), '') as keys from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders) o on o_custkey = c_custkey and i <= 3 group by 1",
    _keys("orders", "o_orderkey"),
)
rest("embed_spread", "orders", "select=o_orderkey,...customer(c_name,c_acctbal::bigint:balance)", "select o_orderkey, c_name, trunc(c_acctbal)::bigint as balance from orders left join customer on o_custkey = c_custkey")
rest(
    "embed_m2m",
    "supplier",
    "select=s_suppkey,part(p_partkey)",
    "select s_suppkey, count(p) as n, coalesce(string_agg(p::varchar, ',' order by p), '') as keys from supplier left join (select distinct l_suppkey, l_partkey as p from lineitem) on l_suppkey = s_suppkey group by 1",
    _keys("part", "p_partkey"),
)
rest(
    "embed_hint",
    "lineitem",
    "select=l_orderkey,l_partkey,l_suppkey,l_linenumber,supplier!lineitem_supplier(s_name)&l_quantity=gte.49",
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, s_name from lineitem left join supplier on l_suppkey = s_suppkey where l_quantity >= 49",
    lambda df: df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "supplier.s_name"),
)
rest(
    "embed_page",
    "orders",
    "select=o_orderkey,o_totalprice,customer(c_name)&o_orderstatus=eq.O&o_totalprice=gt.100000&order=o_totalprice.desc,o_orderkey.asc&limit=25",
    "select o_orderkey, o_totalprice, c_name from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'O' and o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 25",
    lambda df: df.select("o_orderkey", "o_totalprice", "customer.c_name"),
)
rest(
    "embed_page_children",
    "customer",
    "select=c_custkey,orders(o_orderkey,lineitem(l_partkey))&order=c_acctbal.desc,c_custkey&limit=20",
    "with p as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 20) select c_custkey, o_orderkey, count(l_partkey) as lines from p join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1, 2",
    lambda df: df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.size("o.lineitem").cast("long").alias("lines")),
)
rest(
    "embed_aggregate",
    "customer",
    "select=c_custkey,orders(o_orderstatus,count():n)",
    "select c_custkey, o_orderstatus, count(*) as n from customer join orders on o_custkey = c_custkey group by 1, 2",
    lambda df: df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderstatus", "o.n"),
)
rest("null_embed_anti", "orders", "select=o_orderkey&lineitem=is.null", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
rest("null_embed_semi", "customer", "select=c_custkey&events=not.is.null", "select c_custkey from customer where exists (select 1 from events where user_id = c_custkey)")


@frame("self_join", "select a.n_name as nation, b.n_name as peer from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def self_join(spark, sf_dir):
    q = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table_as("nation", "a").inner_join("nation", "a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "b")
    return q.column_raw(F.col("a.n_name").alias("nation")).column_raw(F.col("b.n_name").alias("peer")).build()


@frame("left_join_view", "select o_orderkey, c_name as buyer, n_name as country from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'")
def left_join_view(spark, sf_dir):
    q = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table("orders").left_join("customer", "o_custkey = c_custkey").left_join("nation", "c_nationkey = n_nationkey")
    return q.where("o_orderstatus = 'P'").column("o_orderkey").column_as("c_name", "buyer").column_as("n_name", "country").build()


@frame("lateral_top", "select n_nationkey, c_custkey from nation, lateral (select c_custkey from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2)")
def lateral_top(spark, sf_dir):
    inner = scan(spark, sf_dir, "customer").where(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(2).select("c_custkey")
    out = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table("nation").left_join_lateral(inner, "c").column("n_nationkey").column("c_custkey").build()
    return out.where("c_custkey is not null")


@frame("multi_column_join", "select count(*) as n from lineitem a join (select l_orderkey, l_partkey, max(l_quantity) as q from lineitem group by 1, 2) b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_quantity = b.q")
def multi_column_join(spark, sf_dir):
    l = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    top = l.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("l_quantity"))
    return l.join(top, ["l_orderkey", "l_partkey", "l_quantity"]).agg(F.count("*").alias("n"))


@frame("optional_predicate_join", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey where (null is null or n_name = null) order by s_suppkey")
def optional_predicate_join(spark, sf_dir, country: str | None = None):
    df = scan(spark, sf_dir, "supplier").join(scan(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if country is not None:
        df = df.where(F.col("n_name") == country)
    return df.select("s_suppkey", "n_name")


@frame("batched_children", "select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)) where i <= 2")
def batched_children(spark, sf_dir):
    keys = batched.parent_keys(scan(spark, sf_dir, "customer").where("c_acctbal > 9000"), "c_custkey")
    return batched.children(scan(spark, sf_dir, "orders"), "o_custkey", keys, 2, [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@frame("batched_attach", "select n_name, count(s_suppkey) as n, coalesce(string_agg(s_name, ',' order by s_suppkey), '') as names from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_name")
def batched_attach(spark, sf_dir):
    nations = scan(spark, sf_dir, "nation")
    groups = batched.grouped(scan(spark, sf_dir, "supplier"), "s_nationkey", batched.parent_keys(nations, "n_nationkey"), ["s_suppkey", "s_name"], "s_suppkey")
    out = batched.attach(nations, "n_nationkey", groups, "suppliers")
    return out.select("n_name", F.size("suppliers").cast("long").alias("n"), F.array_join(F.transform("suppliers", lambda x: x["s_name"]), ",").alias("names"))
