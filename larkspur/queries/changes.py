"""Mutations as pure functions, row policies, change capture, rendering."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from larkspur import render
from larkspur.catalog import Context, Name, Policy
from larkspur.engine import Engine
from larkspur.operators import mutate
from larkspur.queries import frame
from larkspur.sources.testdata import catalog, scan
from larkspur.streaming import changes

C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
NEW = "select c_custkey + 1000000 as c_custkey, c_name, c_nationkey, c_acctbal, 'NEW' as c_mktsegment from customer where c_custkey <= 10"
UPSERT = "select c_custkey + 5 as c_custkey, c_name || '*' as c_name, c_nationkey, 0.0::double as c_acctbal, c_mktsegment from customer where c_custkey > (select max(c_custkey) - 10 from customer)"


def _customer(spark, sf_dir):
    return scan(spark, sf_dir, "customer")


def _upserts(spark, sf_dir):
    c = _customer(spark, sf_dir)
    top = c.agg((F.max("c_custkey") - 10).alias("top"))
    return c.join(F.broadcast(top), F.col("c_custkey") > F.col("top")).select((F.col("c_custkey") + 5).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey", F.lit(0.0).alias("c_acctbal"), "c_mktsegment")


@frame("insert_returning", f"select {C} from customer union all {NEW}")
def insert_returning(spark, sf_dir):
    c = _customer(spark, sf_dir)
    rows = c.where("c_custkey <= 10").withColumn("c_custkey", F.col("c_custkey") + 1000000).withColumn("c_mktsegment", F.lit("NEW"))
    return mutate.insert(c, rows)[0]


@frame("upsert_ignore", f"with n as ({UPSERT}) select {C} from customer union all select {C} from n where c_custkey not in (select c_custkey from customer)")
def upsert_ignore(spark, sf_dir):
    return mutate.ignore_duplicates(_customer(spark, sf_dir), _upserts(spark, sf_dir), ["c_custkey"])[0]


@frame("upsert_merge", f"with n as ({UPSERT}) select {C} from customer where c_custkey not in (select c_custkey from n) union all select {C} from n")
def upsert_merge(spark, sf_dir):
    c = _customer(spark, sf_dir)
    return mutate.merge_duplicates(c, _upserts(spark, sf_dir), ["c_custkey"], c.columns)[0]


@frame("upsert_merge_some_columns", f"with n as ({UPSERT}) select c.c_custkey, c.c_name, c.c_nationkey, coalesce(n.c_acctbal, c.c_acctbal) as c_acctbal, c.c_mktsegment from customer c left join n using (c_custkey) union all select {C} from n where c_custkey not in (select c_custkey from customer)")
def upsert_merge_some_columns(spark, sf_dir):
    return mutate.merge_duplicates(_customer(spark, sf_dir), _upserts(spark, sf_dir), ["c_custkey"], ["c_acctbal"])[0]


@frame("update_where", "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as c_mktsegment from customer")
def update_where(spark, sf_dir):
    return mutate.update(_customer(spark, sf_dir), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT")})[0]


@frame("update_returning", "select c_custkey, 'DEBT' as c_mktsegment from customer where c_acctbal < 0")
def update_returning(spark, sf_dir):
    return mutate.update(_customer(spark, sf_dir), F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT")})[1].select("c_custkey", "c_mktsegment")


@frame("partial_update", "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_acctbal < 0 and c_nationkey > 9 then 'DEBT' else c_mktsegment end as c_mktsegment from customer")
def partial_update(spark, sf_dir):
    """Of the columns to set, a null leaves the old value: c_name everywhere, c_mktsegment where the nation is a small number."""
    values = {"c_name": F.lit(None).cast("string"), "c_mktsegment": F.when(F.col("c_nationkey") > 9, F.lit("DEBT"))}
    return mutate.partial_update(_customer(spark, sf_dir), F.col("c_acctbal") < 0, values)[0]


@frame("delete_where", f"select {C} from customer where not (c_mktsegment = 'BUILDING' and c_acctbal > 5000)")
def delete_where(spark, sf_dir):
    return mutate.delete(_customer(spark, sf_dir), (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000))[0]


@frame("delete_using", "select o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 0)")
def delete_using(spark, sf_dir):
    poor = _customer(spark, sf_dir).where("c_acctbal < 0")
    return mutate.delete_using(scan(spark, sf_dir, "orders"), poor, F.col("t.o_custkey") == F.col("u.c_custkey"))[0].select("o_orderkey")


@frame("rls_select", "select c_custkey, c_acctbal from customer where (c_mktsegment = 'BUILDING' or c_nationkey = 3) and c_acctbal > 0")
def rls_select(spark, sf_dir):
    from dataclasses import replace

    customer = Name("public", "customer")
    rules = (
        Policy(customer, ("agent",), "select", lambda ctx: F.col("c_mktsegment") == ctx.claims["segment"]),
        Policy(customer, ("agent",), "select", lambda ctx: F.col("c_nationkey") == ctx.claims["nation"]),
    )
    cat = replace(catalog(spark, sf_dir), policies=rules)
    return Engine(spark, cat).frame("customer", "select=c_custkey,c_acctbal&c_acctbal=gt.0", Context("agent", {"segment": "BUILDING", "nation": 3}))


CHANGED = "select * from customer where c_custkey % 7 <> 0"


@frame(
    "cdc_diff",
    """with v1 as (select c_custkey, c_mktsegment from customer where c_custkey % 5 <> 0),
    v2 as (select c_custkey, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as c_mktsegment from customer where c_custkey % 7 <> 0)
    select case when v1.c_custkey is null then 'INSERT' when v2.c_custkey is null then 'DELETE' else 'UPDATE' end as operation, coalesce(v2.c_custkey, v1.c_custkey) as c_custkey, v1.c_mktsegment as old_segment, v2.c_mktsegment as new_segment
    from v1 full join v2 on v1.c_custkey = v2.c_custkey where v1.c_custkey is null or v2.c_custkey is null or v1.c_mktsegment <> v2.c_mktsegment""",
)
def cdc_diff(spark, sf_dir):
    c = _customer(spark, sf_dir)
    v1 = c.where("c_custkey % 5 <> 0").select("c_custkey", "c_mktsegment")
    v2 = c.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    ch = changes.capture(v1, v2, ["c_custkey"], "customer")
    at = lambda side, f: F.get_json_object(side, f"$.{f}")
    return ch.select("operation", F.coalesce(at("new", "c_custkey"), at("old", "c_custkey")).cast("long").alias("c_custkey"), at("old", "c_mktsegment").alias("old_segment"), at("new", "c_mktsegment").alias("new_segment"))


@frame("stream_subscription", "select event_id, user_id, value from events where event_type = 'purchase' and value > 50")
def stream_subscription(spark, sf_dir):
    """The events table as a file stream, read to its end, through a filtered subscription."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    # A file source watches a folder; a lone file is watched through a glob of its own name.
    source = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else path.replace("events.parquet", "{events}.parquet"))
    return changes.drain(source.where("event_type = 'purchase' and value > 50").select("event_id", "user_id", "value"), folder)


@frame("json_render", """select n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as json from nation""")
def json_render(spark, sf_dir):
    n = scan(spark, sf_dir, "nation")
    return n.select("n_nationkey", render.row_json(n).alias("json"))


@frame("csv_render", "select 'r_regionkey,r_name' as line union all select r_regionkey || ',' || r_name from region")
def csv_render(spark, sf_dir):
    rows = render.rows(scan(spark, sf_dir, "region").orderBy("r_regionkey"))
    return spark.createDataFrame([(line,) for line in render.to_csv(rows).splitlines()], "line string")
