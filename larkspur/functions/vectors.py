"""Distances between vectors, as built-in expressions.

Against a literal vector the sum is written out term by term, which whole-stage code
generation compiles to straight arithmetic; between two columns higher-order functions do it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNROLL = 256


def _sum(a: Column, b: Column | Sequence[float], term) -> Column:
    if isinstance(b, Column):
        return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if len(b) > UNROLL:
        return _sum(a, F.array(*[F.lit(float(x)) for x in b]), term)
    out = None
    for i, x in enumerate(b):
        t = term(F.get(a, F.lit(i)).cast("double"), F.lit(float(x)))
        out = t if out is None else out + t
    return F.lit(0.0) if out is None else out


def inner(a: Column, b: Column | Sequence[float]) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner(a: Column, b: Column | Sequence[float]) -> Column:
    """<#>"""
    return -inner(a, b)


def l2(a: Column, b: Column | Sequence[float]) -> Column:
    """<->"""
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column | Sequence[float]) -> Column:
    if isinstance(a, Column):
        return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.lit(sum(float(x) * float(x) for x in a) ** 0.5)


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """<=>; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.lit(1.0) - F.when(size > 0, inner(a, b) / size)


#: A query set is broadcast: a thousand vectors of a thousand numbers are some 8 MB.
MOST_QUERIES = 1000
DISTANCES = {"l2": l2, "ip": negative_inner, "cosine": cosine}


def nearest(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, distance: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k rows nearest to query, with their distance; ties go to the smaller key. Each partition keeps k rows."""
    out = df.where(F.col(column).isNotNull())
    if where is not None:
        out = out.where(where)
    return out.withColumn("distance", DISTANCES[distance](F.col(column), query)).orderBy("distance", key).limit(k)


def nearest_each(queries: DataFrame, df: DataFrame, column: str, key: str, k: int, distance: str = "cosine") -> DataFrame:
    """The k nearest of df to each row of a stated query set (query_id, query) of at most MOST_QUERIES: each partition keeps k of its pairs."""
    if len(queries.limit(MOST_QUERIES + 1).select("query_id").collect()) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: ask in blocks")
    pairs = df.join(F.broadcast(queries), F.col(key) != F.col("query_id")).withColumn("distance", DISTANCES[distance](F.col(column), F.col("query")))
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
