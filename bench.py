"""Times the headline queries; prints one JSON line. Each query runs once to warm up, then five times; its median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from larkspur.engine import Engine  # noqa: E402
from larkspur.queries import QUERIES  # noqa: E402
from larkspur.sources.testdata import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

#: The request shapes that the published figures are about, over orders and customers.
REQUESTS = {
    "point_lookup": ("orders", "o_orderkey=eq.42"),
    "page_25": ("orders", "select=o_orderkey,o_totalprice,o_orderdate&limit=25"),
    "filtered_ordered_page": ("orders", "o_orderpriority=eq.5-LOW&order=o_orderkey.desc&limit=25"),
    "numeric_range": ("orders", "o_totalprice=gt.250000&limit=25"),
    "exact_count": ("orders", "select=count()&o_totalprice=gt.50000"),
    "page_embed": ("customer", "select=c_custkey,c_name,orders(o_orderkey,o_totalprice)&order=c_custkey&limit=25"),
    "page_embed_two_levels": ("customer", "select=c_custkey,orders(o_orderkey,lineitem(l_partkey,l_quantity))&order=c_custkey&limit=25"),
    "full_embed": ("customer", "select=c_custkey,orders(o_orderkey)"),
    "group_by": ("lineitem", "select=l_returnflag,l_linestatus,sum(l_quantity):qty,avg(l_discount):disc,count():n"),
}
NAMED = ("embed_nested", "embed_m2m", "embed_cap_per_parent", "fts_web", "knn_cosine", "upsert_merge", "cdc_diff", "gql_embed", "agg_sum_product")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, catalog(spark, SF_DIR))
    runs = {n: (lambda t=t, q=q: engine.frame(t, q)) for n, (t, q) in REQUESTS.items()}
    runs |= {n: (lambda n=n: QUERIES[n](spark, SF_DIR)) for n in NAMED}
    out = {}
    for name, make in runs.items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
