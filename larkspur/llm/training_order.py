"""Training-order materialisation: a keyed Feistel permutation gives every sequence its slot, shards have a fixed stride.

Documents are tokenised and laid end to end in each input task, an end id after each, and cut
into sequences of a fixed count of ids; the last one of a task is padded. A sequence's index
is its rank in its task plus a running sum over tasks. The permutation of [0, N) is four
Feistel rounds over the smallest even-bit domain that holds N, walked until it falls inside:
a bijection computed from the key alone, so no shuffle table exists anywhere. Slot s is record
s mod R of shard s div R, at byte (s mod R) * stride: a trainer that has read up to any slot
seeks there. Slots are cut into ranges of whole shards, as many as the session shuffles to at
most, and each range is one task. Shards that already hold the same bytes are left as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import keep, map_file, mix64, open_fs, put_file, shared_dir, small_batches, texts
from larkspur.llm.tokens import part_ids

IDS, END, PAD, KEY, SHARD_ROWS = 2048, 49407, 0, 20240229, 8192
OUT = "slot long, shard long, record long, byte_offset long, n_ids long, ids_crc32 long, doc_ids array<long>"


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """The permutation of range(n) under key, at the given indexes."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << h) | right

    x = once(np.asarray(index, np.uint64))
    while (out := x >= np.uint64(n)).any():  # the domain is under 8 n: few steps a value
        x[out] = once(x[out])
    return x.astype(np.int64)


def _sequences(path: str | None, size: int, end: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, j = part_ids(path), TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        tail = np.array([end], "<u4").tobytes()
        held, docs = np.zeros(0, np.uint16), np.zeros(0, np.int64)  # ids not yet cut, and where in them each document of `names` begins
        names: list = []

        def cut(upto: int) -> pa.RecordBatch:
            """The first `upto` sequences of what is held, the last one short if there is no more."""
            nonlocal j
            rows = []
            for i in range(upto):
                ids = held[i * size : (i + 1) * size]
                a = max(0, int(np.searchsorted(docs, i * size, "right")) - 1)
                b = int(np.searchsorted(docs, i * size + len(ids), "left"))
                rows.append((j, len(ids), squeeze(ids.tobytes()), names[a:b]))
                j += 1
            a, b, c, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.list_(pa.int64()))], ["part", "j", "n_ids", "ids", "doc_ids"])

        for b in small_batches(batches, 256):
            new = [ids_of.of(t) + tail for t in texts(b)]
            length = np.array([len(x) // 4 for x in new], np.int64)
            docs = np.concatenate([docs, len(held) + np.cumsum(length) - length])
            names += b.column(0).to_pylist()
            held = np.concatenate([held, np.frombuffer(b"".join(new), "<u4").astype(np.uint16)])
            if n := len(held) // size:
                yield cut(n)
                held = held[n * size :]
                keep_from = max(0, int(np.searchsorted(docs, n * size, "right")) - 1) if len(held) else len(docs)
                docs, names = docs[keep_from:] - n * size, names[keep_from:]
        if len(held):
            yield cut(1)

    return go


def _slots(n: int, key: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = feistel(b.column(0).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *b.columns[1:]], ["slot", "n_ids", "ids", "doc_ids"])

    return go


def _write(out: str, size: int, shard_rows: int, n: int, pad: int):
    stride = 2 * size

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slot, whole shards in one task: a shard is at most shard_rows records, written once, read back."""
        unpack = zstandard.ZstdDecompressor().decompress
        meta: list[tuple] = []
        data = bytearray()

        def finish() -> pa.RecordBatch:
            shard = meta[0][0] // shard_rows
            rows = min(shard_rows, n - shard * shard_rows)
            if len(meta) != rows:
                raise ValueError(f"shard {shard} has {len(meta)} of {rows} records")
            uri = f"{out}/shard-{shard:08d}.bin"
            fs, path = open_fs(uri)
            if fs.get_file_info(path).size != rows * stride or not map_file(uri).equals(pa.py_buffer(data)):
                put_file(uri, data)
            back = np.frombuffer(map_file(uri), "<u2").reshape(rows, size)
            slot, k, docs = zip(*meta, strict=True)
            at = np.array(slot) % shard_rows
            crc = [zlib.crc32(back[i, :m].astype("<u4").tobytes()) for i, m in zip(at.tolist(), k, strict=True)]
            cols = [pa.array(slot, pa.int64()), pa.array([shard] * rows, pa.int64()), pa.array(at, pa.int64()), pa.array(at * stride, pa.int64()), pa.array(k, pa.int64()), pa.array(crc, pa.int64()), pa.array(docs, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["slot", "shard", "record", "byte_offset", "n_ids", "ids_crc32", "doc_ids"])

        fill = np.array([pad], "<u2").tobytes()
        for b in small_batches(batches, 256):
            for slot, k, ids, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if meta and slot // shard_rows != meta[0][0] // shard_rows:
                    yield finish()
                    meta, data = [], bytearray()
                raw = unpack(ids)
                data += raw + fill * (size - len(raw) // 2)
                meta.append((slot, k, docs))
        if meta:
            yield finish()

    return go


def materialise(docs: DataFrame, out: str | None = None, tokenizer: str | None = None, size: int = IDS, key: int = KEY, shard_rows: int = SHARD_ROWS, end: int = END, pad: int = PAD) -> DataFrame:
    """Writes the shards to `out` (default: the shared folder); one row a sequence: where it lies, its ids' checksum as read back, the documents that it holds.

    doc_ids are in order, the first one possibly continued from another sequence; a null
    doc_id stays null in the list. Null and empty texts are the end id alone. Repeated rows
    are repeated. An empty table writes no shard and gives an empty table. Only doc_id and
    text are read. A task holds one shard (shard_rows * size * 2 bytes) at a time.
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark, "order-shards", lasting=True)
    fs, path = open_fs(out)
    fs.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seqs = keep(docs.mapInArrow(_sequences(tokenizer, size, end), "part int, j long, n_ids long, ids binary, doc_ids array<long>"), "order-seqs")
    counts = seqs.groupBy("part").agg(F.count("*").alias("n"))
    n = seqs.count()
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # One row a task that read; beyond a million of them they are shuffled, not broadcast.
    bases = F.broadcast(bases) if counts.count() <= 1_000_000 else bases
    rows = seqs.join(bases, "part").select((F.col("base") + F.col("j")).alias("i"), "n_ids", "ids", "doc_ids")
    shards = max(1, -(-n // shard_rows))
    rows = rows.mapInArrow(_slots(n, key), "slot long, n_ids long, ids binary, doc_ids array<long>")
    ranges = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionById(ranges, F.floor(F.floor(F.col("slot") / shard_rows) * ranges / shards).cast("int")).sortWithinPartitions("slot")
    return rows.mapInArrow(_write(out, size, shard_rows, n, pad), OUT)


def read_records(out: str, first: int, count: int, size: int = IDS, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """count records from slot `first` on, padding included: what a resumed trainer reads."""
    parts = []
    while count > 0:
        shard, at = divmod(first, shard_rows)
        take = np.frombuffer(map_file(f"{out}/shard-{shard:08d}.bin"), "<u2").reshape(-1, size)[at : at + count]
        if not len(take):
            break
        parts.append(take)
        first, count = first + len(take), count - len(take)
    return np.concatenate(parts) if parts else np.zeros((0, size), "<u2")


def op10_training_order(spark, sf_dir: str) -> DataFrame:
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
