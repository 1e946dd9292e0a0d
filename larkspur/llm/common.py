"""What the corpus operators share: the shared folder, word splitting, Arrow plumbing, bounded label samples.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D; `bytes.split` splits
exactly there and `bytes.lower` changes A-Z alone, so the UTF-8 bytes that Arrow delivers
are split without being decoded.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words longer than this are worked out afresh each time: a cache of short words is bounded in bytes by its entries.
LONG = 64
_own: dict[str, str] = {}
_made: list[str] = []
_held: list = [None, None]


def only(name: object, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks: one cache at a time, the one last asked for."""
    if _held[0] != name:
        _held[:] = [None, None]
        _held[:] = [name, make()]
    return _held[1]


def shared_dir(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A new folder under spark.checkpoint.dir; under one of our own where that is unset and everything runs on one machine.

    What is not lasting goes when the driver's process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, folder, True)
        base = _own["base"] = "file://" + folder
    uri = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not lasting:
        if not _made:
            atexit.register(lambda: [discard(x) for x in _made])
        _made.append(uri)
    return uri


def keep(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, so that a lost executor costs no recomputation."""
    return keep_at(df, label)[0]


def keep_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `keep`, and the folder, for `discard` when nothing reads it any more."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffled(df: DataFrame) -> DataFrame:
    """df for the right side of a join that moves both sides between tasks: however small they are, neither is gathered and held by the driver."""
    return df.hint("merge")


def discard(uri: str) -> None:
    """Removes a folder of the shared place, if it is there."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that every executor sees."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Written under another name first: a task that is repeated leaves whole files alone, and no half ones."""
    fs, path = open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def map_file(uri: str) -> pa.Buffer:
    """A file's bytes, memory-mapped where the shared folder is mounted."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hash by word; long words are not kept, and it is emptied when it has grown past a bound."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONG:
            return xxhash.xxh64_intdigest(word)
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what Python holds at once is small however Spark cuts its batches."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def row_mod(crc_of: str, by: int) -> F.Column:
    return F.crc32(F.col(crc_of).cast("string").cast("binary")) % by


def long_key(word: bytes) -> bytes:
    """What a long word is kept under: a space, which no word has, and 128 bits of hash."""
    return b" " + xxhash.xxh3_128_digest(word)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 5, most_bytes: int = 1 << 18) -> tuple[list[tuple[bytes, int, str | None]], tuple[int, int]]:
    """At most per_class labelled texts of each class with their languages, drawn by hash, and the counts of both classes.

    The sample is uniform within a class and the same on every run. Labels that are null or
    other than 0 and 1 are passed over; so are documents without text. A document labelled
    twice counts once, with its larger label. Only the sample reaches the driver: 2 * per_class
    rows of at most most_bytes by contract; longer texts are scored but not learned from.
    """
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 16))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        bound = int((1 << 48) * min(1.0, 1.2 * per_class / max(n.get(y, 0), 1)))
        part = lab.where((F.col("y") == y) & (F.col("h") < F.lit(bound))).orderBy("h", "doc_id").limit(per_class).select("doc_id", "y")
        ids = part if ids is None else ids.union(part)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang")).where(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"]), seed), r["text"]))
    out, seen = [], set()
    for r in rows:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            out.append((r["text"].encode("utf-8", "replace"), r["y"], r["lang"]))
    return out, (n.get(0, 0), n.get(1, 0))


def without_copies(sample: list[tuple]) -> list[tuple]:
    """The sample less near copies of earlier texts: one text copied often would make each of its words look telling."""
    hashes, seeds = WordHashes(), mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    seen: list[set[int]] = [set() for _ in seeds]
    out = []
    for row in sample:
        h = hashes.of(words(row[0]))
        if len(h) >= 3:
            h = mix64(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:])
        low = [int((h * s).min()) for s in seeds] if len(h) else [0] * len(seeds)
        if sum(a in b for a, b in zip(low, seen, strict=True)) < 3:
            out.append(row)
        for a, b in zip(low, seen, strict=True):
            b.add(a)
    return out
