"""Selection, filters, order, paging, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog import Name, TableDef
from larkspur.functions import ranges
from larkspur.operators.builder import Select
from larkspur.operators.predicates import condition, predicate
from larkspur.operators.read import result_table
from larkspur.plans.grammar import parse_filter, parse_logic
from larkspur.plans.ir import Field
from larkspur.queries import frame, rest
from larkspur.sources.testdata import scan

O = "o_orderkey, o_custkey, o_totalprice"

rest("read_all_columns", "nation", "", "select n_nationkey, n_name, n_regionkey from nation")
rest("read_star", "region", "select=*", "select r_regionkey, r_name from region")
rest("read_select_alias_cast", "customer", "select=c_custkey,c_nationkey::bigint:nation,c_name:name", "select c_custkey, c_nationkey::bigint as nation, c_name as name from customer")
for op, sign in (("eq", "="), ("neq", "<>")):
    rest(f"filter_{op}", "orders", f"select=o_orderkey,o_custkey,o_totalprice&o_orderstatus={op}.O", f"select {O} from orders where o_orderstatus {sign} 'O'")
for op, sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    rest(f"filter_{op}", "orders", f"select=o_orderkey,o_custkey,o_totalprice&o_totalprice={op}.200000", f"select {O} from orders where o_totalprice {sign} 200000")
rest("filter_timestamp_range", "orders", "select=o_orderkey,o_orderdate::date:day&o_orderdate=gte.1996-01-01&o_orderdate=lt.1997-01-01", "select o_orderkey, o_orderdate::date as day from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
rest("filter_like", "part", "select=p_partkey,p_name&p_name=like.red*", "select p_partkey, p_name from part where p_name like 'red%'")
rest("filter_ilike", "part", "select=p_partkey,p_name&p_name=ilike.*WIDGET", "select p_partkey, p_name from part where p_name ilike '%widget'")
rest("filter_match", "part", "select=p_partkey,p_name&p_name=match.^(red|blue)", "select p_partkey, p_name from part where regexp_matches(p_name, '^(red|blue)')")
rest("filter_imatch", "part", "select=p_partkey,p_name&p_name=imatch.^(RED|Blue)", "select p_partkey, p_name from part where regexp_matches(p_name, '(?i)^(red|blue)')")
rest("filter_in", "orders", 'select=o_orderkey&o_orderpriority=in.(1-URGENT,"2-HIGH")', "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
rest("filter_in_empty", "orders", "select=o_orderkey&o_orderpriority=in.()", "select o_orderkey from orders where false")
rest("filter_not_in", "orders", "select=o_orderkey&o_orderpriority=not.in.(1-URGENT,2-HIGH)", "select o_orderkey from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')")
rest("filter_not", "orders", "select=o_orderkey&o_totalprice=not.gt.100000", "select o_orderkey from orders where not (o_totalprice > 100000)")
rest("filter_any", "part", "select=p_partkey&p_size=eq(any).{5,10,15}", "select p_partkey from part where p_size in (5, 10, 15)")
rest("filter_all", "part", "select=p_partkey,p_name&p_name=like(all).{*e*,*a*}", "select p_partkey, p_name from part where p_name like '%e%' and p_name like '%a%'")
rest("logic_or_nested", "orders", "select=o_orderkey&or=(o_totalprice.lt.5000,and(o_orderstatus.eq.F,o_orderpriority.in.(1-URGENT,5-LOW)))", "select o_orderkey from orders where o_totalprice < 5000 or (o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '5-LOW'))")
rest("logic_not_and", "orders", "select=o_orderkey&not.and=(o_orderstatus.eq.F,o_totalprice.gt.50000)", "select o_orderkey from orders where not (o_orderstatus = 'F' and o_totalprice > 50000)")
rest("logic_and_group", "customer", "select=c_custkey&and=(c_acctbal.gt.0,c_mktsegment.not.eq.BUILDING)", "select c_custkey from customer where c_acctbal > 0 and not c_mktsegment = 'BUILDING'")
rest("filter_json_path", "events", "select=event_id,props->>k:k&props->>k=gt.5&event_type=eq.click", "select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') > '5' and event_type = 'click'")
rest("select_json_path", "events", "select=event_id,props->k:k", "select event_id, json_extract_string(props, '$.k') as k from events")
rest("filter_json_contains", "events", 'select=event_id&props=cs.{"k": 7}', "select event_id from events where json_extract_string(props, '$.k') = '7'")
rest("order_desc_nulls", "customer", "select=c_custkey,c_acctbal&order=c_acctbal.desc.nullslast,c_custkey.asc&limit=50", "select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 50")
rest("top_k", "orders", "select=o_orderkey,o_totalprice&order=o_totalprice.desc,o_orderkey&limit=10", "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 10")
rest("offset_page", "orders", "select=o_orderkey,o_totalprice&order=o_totalprice,o_orderkey&limit=25&offset=100", "select o_orderkey, o_totalprice from orders order by o_totalprice nulls last, o_orderkey limit 25 offset 100")
rest("max_rows_cap", "orders", "select=o_orderkey&order=o_orderkey&limit=1000", "select o_orderkey from orders order by o_orderkey limit 40", max_rows=40)
rest("order_by_relation", "orders", "select=o_orderkey,o_custkey&order=customer(c_name).desc,o_orderkey&limit=30", "select o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey order by c_name desc, o_orderkey limit 30")
rest("distinct_cols", "orders", "select=o_orderstatus,o_orderpriority&distinct=true", "select distinct o_orderstatus, o_orderpriority from orders")
rest("point_lookup", "orders", "select=o_orderkey,o_totalprice&o_orderkey=eq.42", "select o_orderkey, o_totalprice from orders where o_orderkey = 42")
rest("agg_sum", "lineitem", "select=sum(l_linenumber)::bigint:total", "select sum(l_linenumber)::bigint as total from lineitem")
rest("agg_avg", "lineitem", "select=l_returnflag,avg(l_linenumber):mean", "select l_returnflag, avg(l_linenumber) as mean from lineitem group by 1")
rest("agg_min_max", "lineitem", "select=min(l_extendedprice):low,max(l_extendedprice):high", "select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem")
rest("agg_count_star", "lineitem", "select=count():n", "select count(*) as n from lineitem")
rest("agg_count", "lineitem", "select=l_linestatus,count(l_partkey):n", "select l_linestatus, count(l_partkey) as n from lineitem group by 1")
rest("agg_group_by", "lineitem", "select=l_returnflag,l_linestatus,sum(l_quantity):qty,count():n", "select l_returnflag, l_linestatus, sum(l_quantity) as qty, count(*) as n from lineitem group by 1, 2")
rest("agg_having", "orders", "select=o_custkey,count():n,max(o_totalprice):top&having=(n.gt.12)", "select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by 1 having count(*) > 12")


@frame("agg_filter_count", "select count(*) as total, count(*) filter (where o_orderstatus = 'O') as open, count(*) filter (where o_orderstatus = 'F') as filled from orders")
def agg_filter_count(spark, sf_dir):
    return scan(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))


@frame("agg_sum_product", "select l_orderkey, round(coalesce(sum(l_quantity * l_extendedprice), 0), 2) as total from lineitem group by 1")
def agg_sum_product(spark, sf_dir):
    return scan(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.coalesce(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), F.lit(0.0)), 2).alias("total"))


@frame("agg_ordered_array", "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by 1")
def agg_ordered_array(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return scan(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda p: p["n_name"]), ",").alias("names"))


@frame("agg_counts_in_one_row", "select (select count(*) from customer) as customers, (select count(*) from orders) as orders, (select count(*) from supplier where s_acctbal < 0) as overdrawn")
def agg_counts_in_one_row(spark, sf_dir):
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(scan(spark, sf_dir, "customer"), "customers").crossJoin(n(scan(spark, sf_dir, "orders"), "orders")).crossJoin(n(scan(spark, sf_dir, "supplier").where("s_acctbal < 0"), "overdrawn"))


def _left_joined(spark, sf_dir):
    o, l = scan(spark, sf_dir, "orders"), scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return o.select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")


JOINED = "orders left join lineitem on o_orderkey = l_orderkey"


def _where(spark, sf_dir, field: str, text: str):
    df = _left_joined(spark, sf_dir)
    return df.where(predicate(result_table(df), parse_filter(Field(field), text)))


@frame("filter_is_null", f"select o_orderkey from {JOINED} where l_orderkey is null")
def filter_is_null(spark, sf_dir):
    return _where(spark, sf_dir, "l_orderkey", "is.null").select("o_orderkey")


@frame("filter_is_true", f"select o_orderkey, l_quantity from {JOINED} where (l_quantity > 40) is true")
def filter_is_true(spark, sf_dir):
    df = _left_joined(spark, sf_dir).withColumn("large", F.col("l_quantity") > 40)
    return df.where(predicate(result_table(df), parse_filter(Field("large"), "is.true"))).select("o_orderkey", "l_quantity")


@frame("filter_is_unknown", f"select o_orderkey from {JOINED} where (l_quantity > 40) is null")
def filter_is_unknown(spark, sf_dir):
    df = _left_joined(spark, sf_dir).withColumn("large", F.col("l_quantity") > 40)
    return df.where(predicate(result_table(df), parse_filter(Field("large"), "is.unknown"))).select("o_orderkey")


@frame("filter_isdistinct", f"select o_orderkey, l_returnflag from {JOINED} where l_returnflag is distinct from 'N'")
def filter_isdistinct(spark, sf_dir):
    return _where(spark, sf_dir, "l_returnflag", "isdistinct.N").select("o_orderkey", "l_returnflag")


@frame("filter_not_drops_nulls", f"select o_orderkey, l_quantity from {JOINED} where not (l_quantity > 10)")
def filter_not_drops_nulls(spark, sf_dir):
    return _where(spark, sf_dir, "l_quantity", "not.gt.10").select("o_orderkey", "l_quantity")


def _words(spark, sf_dir):
    return scan(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))


def _array(op: str, value: str):
    def run(spark, sf_dir):
        df = _words(spark, sf_dir)
        return df.where(predicate(result_table(df), parse_filter(Field("words"), f"{op}.{value}"))).select("p_partkey")

    return run


frame("array_contains", "select p_partkey from part where list_has_all(string_split(p_name, ' '), ['red'])")(_array("cs", "{red}"))
frame("array_contained", "select p_partkey from part where list_has_all(['red', 'blue', 'widget', 'gizmo', 'green'], string_split(p_name, ' '))")(_array("cd", "{red,blue,widget,gizmo,green}"))
frame("array_overlap", "select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'blue'])")(_array("ov", "{red,blue}"))

SPANS = "select l_orderkey, min(l_shipdate)::date as lo, (max(l_shipdate)::date + 1)::date as hi from lineitem group by 1"
A, B = "date '1995-01-01'", "date '1996-01-01'"
RANGE_SQL = {
    "cs": "lo <= date '1995-06-01' and hi >= date '1995-06-02'",
    "cd": f"lo >= {A} and hi <= {B}",
    "ov": f"lo < {B} and hi > {A}",
    "sl": f"hi <= {A}",
    "sr": f"lo >= {B}",
    "nxr": f"hi <= {B}",
    "nxl": f"lo >= {A}",
    "adj": f"hi = {A} or lo = {B}",
}


def _range(op: str):
    text = "[1995-06-01,1995-06-01]" if op == "cs" else "[1995-01-01,1995-12-31]"

    def run(spark, sf_dir):
        day = F.col("l_shipdate").cast("date")
        df = scan(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        df = df.select("l_orderkey", ranges.make(F.col("lo"), F.col("hi"), True, True).alias("span"))
        return df.where(predicate(result_table(df), parse_filter(Field("span"), f"{op}.{text}"))).select("l_orderkey")

    return run


for _op, _sql in RANGE_SQL.items():
    frame(f"range_{_op}", f"with s as ({SPANS}) select l_orderkey from s where {_sql}")(_range(_op))


@frame("cte", "with big as (select o_custkey, o_totalprice from orders where o_totalprice > 300000) select o_custkey, count(*) as n from big group by 1")
def cte(spark, sf_dir):
    big = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table("orders").column("o_custkey").column("o_totalprice").where("o_totalprice > 300000")
    return Select(spark).with_cte("big", big).from_table("big").column_raw(F.count("*").alias("n")).group_by("o_custkey").build()


@frame("subquery_from", "select t.o_orderstatus, t.n from (select o_orderstatus, count(*) as n from orders group by 1) t where t.n > 100")
def subquery_from(spark, sf_dir):
    inner = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table("orders").column_raw(F.count("*").alias("n")).group_by("o_orderstatus")
    return Select(spark).from_raw(inner, "t").qualified_column("t", "o_orderstatus").qualified_column("t", "n").where("t.n > 100").build()


@frame("builder_having_order", "select c_nationkey, max(c_acctbal) as top from customer group by 1 having count(*) > 20 order by top desc, c_nationkey limit 5")
def builder_having_order(spark, sf_dir):
    q = Select(spark, lambda n: scan(spark, sf_dir, n)).from_table("customer").column_raw(F.max("c_acctbal").alias("top")).column_raw(F.count("*").alias("n"))
    return q.group_by("c_nationkey").having("n > 20").order_by("top", desc=True).order_by("c_nationkey").limit(5).build().select("c_nationkey", "top")


@frame("expression_logic", "select p_partkey from part where (p_size < 5 or p_size > 45) and not p_brand = 'Brand#11'")
def expression_logic(spark, sf_dir):
    df = scan(spark, sf_dir, "part")
    t = TableDef(Name("", "part"), lambda s: df, result_table(df).columns)
    return df.where(condition(t, parse_logic("and", "(or(p_size.lt.5,p_size.gt.45),p_brand.not.eq.Brand#11)"))).select("p_partkey")
