"""Children fetched for a batch of parents: distinct keys, rows by key, one array a key, and the arrays put to their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_keys(parents: DataFrame, column: str) -> DataFrame:
    """The distinct keys that are not null."""
    return parents.select(F.col(f"`{column}`").alias("key")).where("key is not null").distinct()


def children(child: DataFrame, column: str, keys: DataFrame, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """The child rows of the keys, `limit` of each at most."""
    out = child.join(keys, F.col(f"`{column}`") == F.col("key"), "left_semi")
    if limit is None:
        return out
    w = Window.partitionBy(column).orderBy(*(order or [F.lit(0)]))
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def grouped(child: DataFrame, column: str, keys: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(key, children): an array of structs a key, in order of a child column."""
    picked = F.struct(F.col(order).alias("o"), F.struct(*columns).alias("v"))
    rows = children(child, column, keys).groupBy(F.col(f"`{column}`").alias("key")).agg(F.array_sort(F.collect_list(picked)).alias("c"))
    return rows.select("key", F.transform("c", lambda x: x["v"]).alias("children"))


def attach(parents: DataFrame, column: str, groups: DataFrame, name: str) -> DataFrame:
    """parents with their children as a column; an empty array where there are none."""
    kind = groups.schema["children"].dataType
    out = parents.join(groups, F.col(f"`{column}`") == F.col("key"), "left").drop("key")
    return out.withColumn(name, F.coalesce("children", F.array().cast(kind))).drop("children")
