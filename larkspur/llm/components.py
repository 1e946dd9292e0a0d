"""Connected components of an edge table, without a driver: few edges in one task, more by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, keep_at, shuffled

#: So many distinct edges are united in one task: some 100 MB of Python at most, where rounds would cost the driver dozens of plans.
FEW = 300_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to one (node, the smallest that it reaches) for each node but the smallest."""
    at: dict = {}
    up: list[int] = []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            i, j = (at.setdefault(x, len(at)) for x in (a, b))
            up.extend(range(len(up), len(at)))
            i, j = top(i), top(j)
            up[max(i, j)] = min(i, j)
    least: dict = {}
    for x, i in at.items():
        r = top(i)
        if r not in least or x < least[r]:
            least[r] = x
    rows = [(x, r) for x, i in at.items() if (r := least[top(i)]) != x]
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096], strict=True), schema.types, strict=True)], schema.names)


def components(edges: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Rows (node, root) for each node of edges (a, b): root is the smallest node that it reaches.

    Self links and repeated links are allowed, nulls are dropped, no edge gives no row. At most
    `few` distinct edges are united in one task. Of more, every round is two shuffles of the
    edges, written to the shared folder; the count of rounds grows as the logarithm of the
    longest chain. A star's centre with very many leaves is safe: groups are reduced with min,
    never collected.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    e, folder = keep_at(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if e.count() <= few:
        e, _ = keep_at(e.coalesce(1).mapInArrow(_unite, e.schema), "cc")
        discard(folder)
    else:
        e = _rounds(e, folder, most_rounds)
    root = e.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(shuffled(root), nodes["node"] == root["a"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _rounds(e: DataFrame, folder: str, most_rounds: int) -> DataFrame:
    """Distinct edges (a, b), b the smaller, kept in folder, to one (node, the smallest that it reaches) for each node but the smallest."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
    old = mark(e)
    for _ in range(most_rounds):
        # large star: each larger neighbour of u links to u's smallest neighbour (or u)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(shuffled(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: u and its smaller neighbours link to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        e, now = keep_at(small.distinct(), "cc")
        discard(folder)
        folder, new = now, mark(e)
        if new == old:
            return e
        old = new
    raise RuntimeError("components did not settle")
