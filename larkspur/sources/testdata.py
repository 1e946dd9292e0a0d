"""The catalog of a folder of Parquet tables with the TPC-H-like star schema and the corpus tables."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from larkspur.catalog import Catalog, Relationship, TableDef, foreign_key, many_to_many, table_of

KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
}
LINKS: list[Relationship] = [
    *foreign_key("nation_region", "nation", ["n_regionkey"], "region", ["r_regionkey"]),
    *foreign_key("customer_nation", "customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    *foreign_key("supplier_nation", "supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    *foreign_key("orders_customer", "orders", ["o_custkey"], "customer", ["c_custkey"]),
    *foreign_key("lineitem_orders", "lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    *foreign_key("lineitem_part", "lineitem", ["l_partkey"], "part", ["p_partkey"]),
    *foreign_key("lineitem_supplier", "lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    *foreign_key("events_customer", "events", ["user_id"], "customer", ["c_custkey"]),
    *foreign_key("labels_documents", "labels", ["doc_id"], "documents", ["doc_id"], unique=True),
    *many_to_many("lineitem", ("part", "p_partkey", "l_partkey"), ("supplier", "s_suppkey", "l_suppkey")),
]


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _table(spark: SparkSession, folder: str, name: str) -> TableDef:
    df = scan(spark, folder, name)
    return table_of(df, name, KEYS[name], load=lambda s: scan(s, folder, name), json=("props",) if name == "events" else ())


@lru_cache(maxsize=32)
def _catalog(spark: SparkSession, folder: str) -> Catalog:
    names = [n for n in KEYS if "://" in folder or Path(f"{folder}/{n}.parquet").exists()]
    tables = [_table(spark, folder, n) for n in names]
    return Catalog({t.name: t for t in tables}, tuple(LINKS), version=spark.version)


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return _catalog(spark, str(folder))
