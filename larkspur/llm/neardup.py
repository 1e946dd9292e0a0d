"""MinHash near-duplicates: a multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets.

1. Equal word sequences fold into one node (a 128-bit digest), however often they are copied.
2. A node has 32 symbols of 16 bits, one per MinHash. They are cut into 8 chunks of 4; a
   chunk's one allowed error is enumerated by leaving each symbol out in turn: 32 keys.
   By pigeonhole two signatures that differ in at most 15 symbols have a chunk with at most
   one error, so they share a key; none is missed. At similarity 0.85 a pair differs in 4.8
   symbols on average and in more than 15 with a chance of about 3e-6.
3. Of the nodes under one key, everything is first compared with a hub; after these links
   have been confirmed and merged, only pairs whose components still differ are compared.
   So a group of n near copies costs about n comparisons. Every candidate pair of different
   components under the distance threshold is confirmed or refuted on full sets.

A key with more than BLOCK nodes is split into blocks, each with its own hub, and the hubs
are compared among themselves. What keys of more than DENSE nodes have left is joined on full
sets, exactly and without visiting every block: under one order of all shingles, rarest first,
two sets that are similar enough share one of the first shingles of either (prefix filtering),
the smaller one's among its very first. Texts that share a template, but are not similar
enough, have their own rare shingles there, and never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, WordHashes, keep, mix64, shuffled, small_batches, texts, words
from larkspur.llm.components import components

SHINGLE, SYMBOLS, CHUNK, BLOCK, DENSE = 5, 32, 4, 2048, 256
#: A task that confirms pairs holds so many nodes' sets at most, and so many shingles of them, or one set.
FAMILY, LEADS, HELD = 4096, 512, 8_000_000
#: Sets that the order of shingles is learned from (any order gives the same links), and its count buckets.
ORDERED, BUCKETS = 4096, 1 << 18
THRESHOLD = 2 * SYMBOLS // CHUNK - 1
_MUL = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_PERM = mix64(np.arange(1, 1 + SYMBOLS, dtype=np.uint64)) | np.uint64(1)
SIG_BYTES = 2 * SYMBOLS
NODE_SCHEMA = "doc_id long, text_key long, node binary, n long, sig binary"


def shingles(ws: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter; none if it is empty."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = hashes.of(ws)
    k = min(SHINGLE, len(h))
    total = h[: len(h) - k + 1] * _MUL[0]
    for j in range(1, k):
        total = total + h[j : len(h) - k + 1 + j] * _MUL[j]
    return np.unique(mix64(total + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """32 symbols of 16 bits: the smallest value under each of 32 multiplicative orders of already mixed hashes, folded."""
    low = mix64(np.array([(s * p).min() for p in _PERM], np.uint64))
    return (low >> np.uint64(48)).astype(np.uint16).view(np.uint8)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in small_batches(batches):
        node, n, sig = [], [], []
        for t in texts(b):
            ws = words(t)
            s = shingles(ws, hashes)
            n.append(len(s))
            node.append(hashlib.md5(b" ".join(ws)).digest() if ws else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_key", "node", "n", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) to one row a key: chunk, symbol left out, the other three symbols."""
    for b in small_batches(batches, 4096):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, SIG_BYTES)
        sig = sig.view(np.uint16).astype(np.uint64)
        keys = []
        for c in range(SYMBOLS // CHUNK):
            for out in range(CHUNK):
                key = np.full(b.num_rows, c * CHUNK + out, np.uint64)
                for j in range(CHUNK):
                    if j != out:
                        key = (key << np.uint64(16)) | sig[:, c * CHUNK + j]
                keys.append(key.astype(np.int64))
        rows = np.tile(np.arange(b.num_rows), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(pa.array(rows))], ["key", "node"])


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows with equal `by` in a sorted stream."""
    held: list[tuple] = []
    last = None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        at = [b.schema.get_field_index(x) for x in by]
        for row in zip(*cols, strict=True):
            k = tuple(row[i] for i in at)
            if k != last:
                if held:
                    yield held
                held, last = [], k
            held.append(row)
    if held:
        yield held


class _Run:
    """The signatures and sizes of the nodes under one key."""

    def __init__(self, run: list[tuple], n: int, sig: int, percent: int):
        raw = np.frombuffer(b"".join(r[sig] for r in run), np.uint8).reshape(len(run), SIG_BYTES)
        self.n = np.array([r[n] for r in run], np.int64)
        self.index, self.percent = raw.view(np.uint16), percent

    def near(self, i: int, upto: int | None = None) -> np.ndarray:
        """Which nodes (the first `upto`) are candidates of node i: signatures within the threshold, sizes equal enough."""
        n = self.n[:upto]
        d = (self.index[:upto] != self.index[i]).sum(1)
        ok = (d <= THRESHOLD) & (100 * np.minimum(n, self.n[i]) >= self.percent * np.maximum(n, self.n[i]))
        ok[i : i + 1] = False
        return ok


def _hub_pairs(percent: int, upper: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, node, n, sig, hot) to (kind, key, a, b, n, sig).

        kind 0: b is a candidate of hub a. kind 1: b and a are joined by candidates, directly
        or through others of the run. kind 2: a is the hub of a block of a hot key.
        """
        for run in _runs(batches, ("key", "block")):
            r = _Run(run, 3, 4, percent)
            # The hub is nearest to a spread sample of the run: of near copies, about the text that they were made from.
            some = r.index[:: len(run) // 48 + 1]
            hub = int((r.index[:, None] != some[None]).sum((1, 2)).argmin()) if len(run) > 2 else 0
            ok = r.near(hub)
            part = np.arange(len(run))
            part[ok] = hub
            if len(run) > 2:
                for i in np.flatnonzero(~ok):
                    if i != hub and (near := r.near(int(i))).any():
                        near[i] = True
                        joined = np.isin(part, part[near])
                        part[joined] = part[near].min()
            rows = [(0, run[hub][0], run[hub][2], run[i][2], None, None) for i in np.flatnonzero(ok)]
            lead: dict[int, int] = {}
            for i, x in enumerate(part.tolist()):
                if lead.setdefault(x, i) != i and not (ok[i] and (lead[x] == hub or ok[lead[x]])) and not (i == hub and ok[lead[x]]):
                    rows.append((1, run[hub][0], run[lead[x]][2], run[i][2], None, None))
            if run[hub][5] and not upper:
                rows.append((2, run[hub][0], run[hub][2], None, run[hub][3], run[hub][4]))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["kind", "key", "a", "b", "n", "sig"])

    return go


def _cross_pairs(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, n, sig, root, rest) of keys of one block: to candidate pairs of different roots, one of them off the key's main component."""
        for run in _runs(batches, ("key",)):
            r = _Run(run, 2, 3, percent)
            roots: dict[bytes, int] = {}
            root = np.array([roots.setdefault(x[4], len(roots)) for x in run])
            rest = np.array([x[5] for x in run])
            at = np.arange(len(run))
            # Of two nodes off the main component, the later one meets the other, not both.
            pairs = [(run[i][1], run[j][1]) for i in np.flatnonzero(rest) for j in np.flatnonzero(r.near(int(i)) & (root != root[i]) & (~rest | (at > i)))]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["a", "b"])

    return go


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the sets (set) have a shingle in each bucket."""
    total = np.zeros(BUCKETS, np.int32)
    for b in batches:
        for s in b.column(0).to_pylist():
            np.add.at(total, _bucket(np.frombuffer(s, np.uint64)), 1)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def prefix(s: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's shingles that it looks with, rarest first, and how many of them it is found by among sets no smaller.

    Sets x and y, |x| <= |y|, that are similar enough have 100 * common >= percent * |y| and
    (100 + percent) * common >= percent * (|x| + |y|) >= 2 * percent * |x|, so the first
    |y| - least + 1 of y and the first |x| - least + 1 of x meet.
    """
    n = len(s)
    look, found = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
    first = np.lexsort((s, counts[_bucket(s)]))[:look]
    return s[first], found


def _prefixes(percent: int, counts):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, root, set) to one row a prefix shingle."""
        of = np.frombuffer(counts.value, np.int32)
        for b in small_batches(batches, 256):
            key, rows, n, index = [], [], [], []
            for i, s in enumerate(b.column(2).to_pylist()):
                s = np.frombuffer(s, np.uint64)
                tokens, found = prefix(s, percent, of)
                key.append(tokens.view(np.int64))
                rows.append(np.full(len(tokens), i))
                n.append(np.full(len(tokens), len(s)))
                index.append(np.arange(len(tokens)) < found)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(n)), pa.array(np.concatenate(index))], ["key", "node", "root", "n", "index"])

    return go


def _prefix_pairs(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, node, n, root, index, rest, home), a block's own nodes (home -1) before its visitors by their home block: to pairs of different roots of which the smaller set is found by the key.

        Held are a block's own nodes and the visitors from one other block.
        """
        at, own = None, []
        for run in _runs(batches, ("key", "block", "home")):
            if at != run[0][:2]:
                at, own = run[0][:2], []
            inner = run[0][7] < 0
            if inner:
                own = run
            elif not own:
                continue
            both = own if inner else own + run
            roots: dict[bytes, int] = {}
            root = np.array([roots.setdefault(x[4], len(roots)) for x in both])
            n, index, rest = (np.array([x[k] for x in both]) for k in (3, 5, 6))
            o = slice(0, len(own))
            # Of two nodes off the main component one meets the other: the later one in a block, the one from a lower block between two.
            late = np.arange(len(own)) if inner else np.full(len(own), len(both) if run[0][7] < run[0][1] else -1)
            a, b = [], []
            for i in np.flatnonzero(rest[0 if inner else len(own) :]) + (0 if inner else len(own)):
                ok = (root[o] != root[i]) & (~rest[o] | (late > i)) & (100 * np.minimum(n[o], n[i]) >= percent * np.maximum(n[o], n[i]))
                ok &= ((n[o] <= n[i]) & index[o]) | ((n[o] >= n[i]) & index[i])
                hits = np.flatnonzero(ok).tolist()
                a += [both[i][2]] * len(hits)
                b += [both[j][2] for j in hits]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return go


def _mains(rows: DataFrame) -> DataFrame:
    """Per key of rows (key, root) that has several roots: the most frequent one, and how many rows there are."""
    return rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("size")).where("roots > 1").select("key", "main", "size")


def hot_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, root) of different roots that may be similar enough, by their full sets; no other pair of them is."""
    spark = nodes.sparkSession
    some = nodes.select("node").orderBy("node").limit(ORDERED)
    counts = np.zeros(BUCKETS, np.int32)
    for r in sets.join(F.broadcast(some), "node").select("set").repartition(8).mapInArrow(_tally, "counts binary").collect():
        counts += np.frombuffer(r["counts"], np.int32)
    shared = spark.sparkContext.broadcast(counts.tobytes())
    rows = nodes.join(shuffled(sets), "node").select("node", "root", "set").mapInArrow(_prefixes(percent, shared), "key long, node binary, root binary, n long, index boolean")
    rows = keep(rows, "nd-prefixes")
    rows = rows.join(shuffled(_mains(rows)), "key").withColumn("rest", F.col("root") != F.col("main"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("home", F.pmod(F.hash("node"), blocks))
    rows = rows.withColumn("block", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("home"))))
    rows = rows.withColumn("home", F.when(F.col("home") == F.col("block"), -1).otherwise(F.col("home"))).select("key", "block", "node", "n", "root", "index", "rest", "home")
    rows = rows.repartition(_parts(rows), "key", "block").sortWithinPartitions("key", "block", "home", "node")
    return rows.mapInArrow(_prefix_pairs(percent), "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in small_batches(batches):
        node, out = [], []
        for x, t in zip(b.column(b.schema.get_field_index("node")).to_pylist(), texts(b), strict=True):
            ws = words(t)
            if hashlib.md5(b" ".join(ws)).digest() == x:
                node.append(x)
                out.append(shingles(ws, hashes).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(out, pa.binary())], ["node", "set"])


def _confirm(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (site, block, node, leads, set) sorted so that a block's leads (null) precede the nodes to compare with some of them: to confirmed links (a, b)."""
        at, held = None, {}
        for batch in small_batches(batches, 256):
            a, b = [], []
            for site, block, node, leads, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(s, np.uint64)
                if at != (site, block):
                    at, held = (site, block), {}
                if leads is None:
                    held[node] = s
                    continue
                for lead in leads:
                    own = held[lead]
                    both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(lead)
                        b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return go


def confirmed(pairs: DataFrame, sets: DataFrame, family: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are similar enough.

    Pairs are confirmed where their family is (the component of the hub candidates), so that
    a set travels once to each block of leads, not once a pair. A task holds the sets of one
    block's leads, about LEADS and HELD shingles; what they are compared with streams past.
    """
    pairs = pairs.join(shuffled(family), pairs["a"] == family["node"], "left").select(F.coalesce("root", "a").alias("site"), "a", "b")
    lead = pairs.select("site", "a").distinct().join(shuffled(sizes.withColumnRenamed("node", "a")), "a")
    many = lead.groupBy("site").agg(F.greatest(F.ceil(F.count("*") / LEADS), F.ceil(F.sum("n") / HELD)).cast("int").alias("blocks"))
    pairs = pairs.join(shuffled(many), "site").withColumn("block", F.pmod(F.hash("a"), F.col("blocks")))
    none = F.lit(None).cast("array<binary>")
    lead = pairs.select("site", "block", F.col("a").alias("node")).distinct().withColumn("leads", none)
    rest = pairs.groupBy("site", "block", F.col("b").alias("node")).agg(F.collect_list("a").alias("leads"))
    rows = lead.union(rest).join(shuffled(sets), "node").select("site", "block", "node", "leads", "set")
    rows = rows.repartition(_parts(rows), "site", "block").sortWithinPartitions("site", "block", F.col("leads").isNotNull())
    return rows.mapInArrow(_confirm(percent), "a binary, b binary")


def _confirm_family(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (site, kind, a, b, set) sorted so that a family's sets (kind 0) precede its pairs (kind 1): to confirmed links (a, b)."""
        at, held = None, {}
        for batch in small_batches(batches, 1024):
            a, b = [], []
            for site, kind, x, y, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != site:
                    at, held = site, {}
                if kind == 0:
                    held[x] = np.frombuffer(s, np.uint64)
                    continue
                p, q = held[x], held[y]
                if len(q) > len(p):
                    p, q = q, p
                both = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return go


def confirmed_pairs(pairs: DataFrame, sets: DataFrame, family: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are similar enough.

    Pairs inside a family of at most FAMILY nodes and HELD shingles meet the family's sets in
    one task, each set sent once; pairs of larger families, and between families, go through
    `confirmed`.
    """
    of = family.join(shuffled(sizes), "node").groupBy("root").agg(((F.count("*") <= FAMILY) & (F.sum("n") <= HELD)).alias("small"))
    site = family.join(shuffled(of), "root")
    left = site.select(F.col("node").alias("a"), F.col("root").alias("site"), "small")
    right = site.select(F.col("node").alias("b"), F.col("root").alias("other"))
    placed = keep(pairs.join(shuffled(left), "a").join(shuffled(right), "b").select("a", "b", "site", (F.col("small") & (F.col("site") == F.col("other"))).alias("inside")), "nd-placed")
    inside = placed.where("inside")
    none = F.lit(None).cast("binary")
    held = sets.join(shuffled(left.withColumnRenamed("a", "node")), "node").join(shuffled(inside.select("site").distinct()), "site", "left_semi")
    rows = held.select("site", F.lit(0).alias("kind"), F.col("node").alias("a"), none.alias("b"), "set").union(inside.select("site", F.lit(1).alias("kind"), "a", "b", none.alias("set")))
    rows = rows.repartition(_parts(rows), "site").sortWithinPartitions("site", "kind")
    return rows.mapInArrow(_confirm_family(percent), "a binary, b binary").union(confirmed(placed.where("not inside").select("a", "b"), sets, family, sizes, percent))


def _parts(df: DataFrame) -> int:
    """Python work is heavier than its bytes: as many partitions as the session shuffles to, none coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def labelled(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_key, n, component, and rep_id, rep_key of the row that stays for its group (null for texts without words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = keep(docs.mapInArrow(_nodes, NODE_SCHEMA), "nd-rows")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("low")
    nodes = keep(rows.where("node is not null").groupBy("node").agg(low, F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("text_key").alias("text_key")), "nd-nodes")

    keyed = nodes.select("node", "sig").mapInArrow(_keys, "key long, node binary")
    # Nodes that share a key with none are dropped before any comparison.
    shared = keyed.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    shared = keep(shared.join(shuffled(nodes.select("node", "n", "sig")), "node").select("key", "node", "n", "sig", "size"), "nd-keys")
    hot = F.col("size") > BLOCK
    blocks = F.when(hot, F.pmod(F.hash("node"), F.ceil(F.col("size") / BLOCK).cast("int"))).otherwise(F.lit(0))
    blocked = shared.withColumn("block", blocks)
    cols = ["key", "block", "node", "n", "sig"]
    by = lambda df, *first: df.repartition(_parts(df), "key", "block").sortWithinPartitions("key", "block", *first, "node")
    schema = "kind int, key long, a binary, b binary, n long, sig binary"
    found = keep(by(blocked.select(*cols, hot.alias("hot"))).mapInArrow(_hub_pairs(percent, False), schema), "nd-hubs")
    upper = found.where("kind = 2").select("key", F.lit(0).alias("block"), F.col("a").alias("node"), "n", "sig", F.lit(False).alias("hot"))
    upper = by(upper).mapInArrow(_hub_pairs(percent, True), schema)
    both = keep(found.where("kind < 2").select("kind", "a", "b").union(upper.select("kind", "a", "b")).distinct(), "nd-pairs")
    hubs = both.where("kind = 0").select("a", "b")
    any_hot = shared.where(hot).limit(1).count() > 0
    family = components(both)
    if any_hot:  # their nodes may have candidates in other blocks: without one so far, each is its own family
        family = family.join(shuffled(shared.where(hot).select("node").distinct()), "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    family = keep(family, "nd-family")

    # The sets of all nodes that have or may have a candidate, once, for both rounds.
    need = keep(family.select("node").join(shuffled(nodes.select("node", "text_key", "n")), "node"), "nd-need")
    sizes = need.select("node", "n")
    # The nodes grow with the corpus, so they are never broadcast to it.
    text = docs.select("text_key", "text").join(shuffled(need.select("node", "text_key")), "text_key").dropDuplicates(["text_key", "node"]).select("node", "text")
    sets = keep(text.mapInArrow(_sets, "node binary, set binary"), "nd-sets")

    links = keep(confirmed_pairs(hubs, sets, family, sizes, percent), "nd-links")
    root = components(links)
    # Under a key of one block, only nodes with a candidate can be in a pair; those of hot keys are all there.
    rooted = blocked.join(shuffled(need.select("node")), "node", "left_semi").join(shuffled(root), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mains = keep(_mains(rooted), "nd-mains")
    rooted = rooted.drop("size").join(shuffled(mains), "key").withColumn("rest", F.col("root") != F.col("main"))
    rest = rooted.where(F.col("size") <= DENSE).select("key", "node", "n", "sig", "root", "rest")
    cross = rest.repartition(_parts(rest), "key").sortWithinPartitions("key", "node").mapInArrow(_cross_pairs(percent), "a binary, b binary")
    if mains.where(F.col("size") > DENSE).limit(1).count():
        burning = keep(rooted.where(F.col("size") > DENSE).select("node", "root").distinct(), "nd-burning")
        cross = cross.union(hot_pairs(burning, sets, percent))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = keep(confirmed_pairs(cross.distinct(), sets, family, sizes, percent), "nd-more")
    root = components(links.union(more))

    label = nodes.select("node", "low").join(shuffled(root), "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = label.groupBy("root").agg(F.min("low").alias("rep"))
    member = label.join(shuffled(lows), "root").select("node", "rep")
    out = rows.select("doc_id", "text_key", "node", "n").join(shuffled(member), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    return out.select("doc_id", "text_key", "n", component.alias("component"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Linked are texts with 100 * intersection >= percent * union of their shingle sets.
    Null and empty texts, and those of white space alone, have 0 shingles and no link: each
    is its own component, and kept. component_id is the smallest doc_id reachable, null if
    all of them are null; a row with a null doc_id is kept only if its text has no words.
    Repeated rows are one node, and each gets its row. An empty table gives an empty table.
    Only doc_id and text are read.
    """
    kept = F.when(F.col("n") == 0, F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)))
    return labelled(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less all but one of each group of linked texts.

    The row with the smallest doc_id stays (null after all others), one of it if it is
    repeated. Texts without words all stay.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"), "text")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    stay = labelled(docs.select("doc_id", "text"), percent).where("n > 0").select(F.coalesce("rep_id", F.lit(-1)).alias("rid"), F.col("rep_id").isNull().alias("rnull"), F.col("rep_key").alias("rkey")).distinct()
    same = (F.coalesce("id", F.lit(-1)) == F.col("rid")) & (F.col("id").isNull() == F.col("rnull")) & (F.col("key") == F.col("rkey"))
    one = rows.where(~blank).join(shuffled(stay), same, "left_semi").withColumn("idn", F.coalesce("id", F.lit(-1))).withColumn("nul", F.col("id").isNull()).dropDuplicates(["idn", "nul", "key"])
    return one.select("row.*").union(rows.where(blank).select("row.*"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, len(sh)::bigint as n from s),
e as (select doc_id, unnest(sh) as x from s),
u as (select x from e group by x having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join u using (x) join e b on b.x = a.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
g as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from n union select r.a, g.b from r join g on r.b = g.a),
c as (select a, min(b) as c from r group by a)
select n.doc_id, n.n as n_shingles, c.c as component_id, n.doc_id = c.c as kept from n join c on n.doc_id = c.a
"""
