"""GraphQL documents over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.graphql.resolve import root_frame
from larkspur.queries import frame
from larkspur.sources.testdata import catalog


def gql(name: str, document: str, sql: str, then=None, variables: dict | None = None) -> None:
    def run(spark, sf_dir):
        df = root_frame(Engine(spark, catalog(spark, sf_dir)), document, variables or {})
        return then(df) if then else df

    frame(name, sql)(run)


gql("gql_list", '{ orders(filter: {o_orderstatus: {eq: "F"}, o_totalprice: {gt: 150000}}, orderBy: ["o_orderkey.asc"], limit: 40) { o_orderkey o_totalprice } }', "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 150000 order by o_orderkey limit 40")
gql("gql_by_pk", "{ customerByPk(c_custkey: 12) { c_custkey c_name } }", "select c_custkey, c_name from customer where c_custkey = 12")
gql(
    "gql_filter_tree",
    "query q($lo: Float) { orders(filter: {_or: [{o_totalprice: {lt: $lo}}, {_and: [{o_orderstatus: {_eq: \"O\"}}, {_not: {o_orderpriority: {in: [\"1-URGENT\", \"2-HIGH\"]}}}]}]}) { o_orderkey } }",
    "select o_orderkey from orders where o_totalprice < 3000 or (o_orderstatus = 'O' and not o_orderpriority in ('1-URGENT', '2-HIGH'))",
    variables={"lo": 3000.0},
)
gql("gql_in_empty", "{ orders(filter: {o_orderkey: {in: []}}) { o_orderkey } }", "select o_orderkey from orders where false")
gql("gql_shorthand_like", '{ part(filter: {p_size: 7, p_name: {startsWith: "red"}}) { p_partkey p_name } }', "select p_partkey, p_name from part where p_size = 7 and p_name like 'red%'")
gql("gql_order_spellings", '{ suppliers: supplier(orderBy: ["s_acctbal_DESC", "s_suppkey.asc"], limit: 5, offset: 2) { s_suppkey s_acctbal } }', "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 5 offset 2")
gql(
    "gql_embed",
    "{ nation { n_name region { r_name } customers { c_custkey } } }",
    "select n_name, r_name, count(c_custkey) as customers from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2",
    lambda df: df.select("n_name", "region.r_name", F.size("customers").cast("long").alias("customers")),
)
gql(
    "gql_nested_arguments",
    '{ customer { c_custkey orders(filter: {o_totalprice: {gt: 100000}}, orderBy: ["o_orderkey.desc"], limit: 2) { o_orderkey } } }',
    "select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey desc), '') as keys from customer left join (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as i from orders where o_totalprice > 100000) o on o_custkey = c_custkey and i <= 2 group by 1",
    lambda df: df.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys")),
)
