"""Packing documents into sequences of 2048 ids by non-negative least squares on the length histogram.

A document's ids are cut into whole windows and a rest. Only the histogram of lengths (2048
numbers at most) reaches the driver. There, combinations of two to four lengths that fill a
window exactly are enumerated, repeat counts are solved for by non-negative least squares and
rounded down, and what the histogram has left is laid out greedily, longest first, cut where
a window ends. So each combination is whole pieces, and only the last sequence is padded.

A piece's rank among pieces of its length decides its place. Ranks come from counts per task
and running sums over tasks: no window over rows, however common one length is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import keep, small_batches, texts
from larkspur.llm.tokens import part_ids

WINDOW, END = 2048, 1
PIECES = "part int, j long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str | None, window: int, end: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to pieces of at most `window` ids; a piece shorter than that carries its ids (16 bits each)."""
        ids_of, part = part_ids(path), TaskContext.get().partitionId()
        ranks = np.zeros(window + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for b in small_batches(batches, 256):
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                ids = ids_of.of(text) + tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    k = len(piece) // 4
                    rest = None if k == window else np.frombuffer(piece, "<u4").astype("<u2").tobytes()
                    for c, v in zip(out, (int(ranks[k]), doc, start, k, zlib.crc32(piece), n, rest), strict=True):
                        c.append(v)
                    ranks[k] += 1
            kinds = [pa.int64()] * 6 + [pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), part, np.int32)), *cols], ["part", "j", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"])

    return go


def combinations(lengths: np.ndarray, window: int, most: int = 20_000) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a window exactly: all pairs, then triples and quadruples that start with spread-out lengths."""
    have = set(lengths.tolist())
    out = {tuple(sorted((a, window - a), reverse=True)) + (0, 0) for a in have if window - a in have}
    desc = sorted(have, reverse=True)

    def spread(upto: int, k: int) -> list[int]:
        fit = [x for x in desc if x <= upto]
        return fit if len(fit) <= k else [fit[i * (len(fit) - 1) // (k - 1)] for i in range(k)]

    for a in desc:
        for b in spread(min(a, window - a - 1), 12):
            c = window - a - b
            if 0 < c <= b and c in have:
                out.add((a, b, c, 0))
            for c in spread(min(b, window - a - b - 1), 6):
                d = window - a - b - c
                if 0 < d <= c and d in have:
                    out.add((a, b, c, d))
        if len(out) >= most:
            break
    return np.array(sorted(out, reverse=True)[:most], np.int64).reshape(-1, 4)


def repeats(combos: np.ndarray, hist: np.ndarray, steps: int = 2000, still: float = 1e-5) -> np.ndarray:
    """Whole repeat counts: minimise |A x - hist|, x >= 0, by multiplicative updates (A's columns count a combination's lengths) until ten of them change the residual by less than `still` of it; then round down within the histogram."""
    if not len(combos):
        return np.zeros(0, np.int64)
    used = combos > 0
    grow = lambda v: (v[combos] * used).sum(1)  # A' v
    aim = grow(hist.astype(float))
    x = aim / used.sum(1) / max(1, len(combos))
    last = np.inf
    for step in range(steps):
        have = np.bincount(combos.ravel(), np.repeat(x, 4) * used.ravel(), len(hist))
        if step % 10 == 0:
            residual = float(np.linalg.norm(have - hist))
            if residual >= last * (1 - still) or residual < 1e-9:
                break
            last = residual
        x *= aim / np.maximum(grow(have), 1e-12)
    left, n = hist.copy(), np.zeros(len(combos), np.int64)
    for i in np.argsort(-x, kind="stable"):
        need = np.bincount(combos[i][used[i]], minlength=len(hist))
        at = np.flatnonzero(need)
        n[i] = max(0, min(int(x[i] + 1e-9), int((left[at] // need[at]).min())))
        left[at] -= n[i] * need[at]
    return n


def plan(hist: np.ndarray) -> dict[str, np.ndarray]:
    """From counts by length (index 0 to window) to runs of ranks, sorted by (length, first rank).

    A run's pieces go to sequences seq, seq + 1, ... at one offset; a run with stream >= 0 is
    laid end to end from that position of the residual stream, whose first sequence is seq.
    """
    window = len(hist) - 1
    lengths = np.flatnonzero(hist[:window])
    combos = combinations(lengths, window)
    n = repeats(combos, hist[:window])
    runs = [(window, 0, 0, 0, -1)] if hist[window] else []
    taken, seq = np.zeros(window + 1, np.int64), int(hist[window])
    for combo, k in zip(combos.tolist(), n.tolist(), strict=True):
        if k:
            offset = 0
            for length in combo:
                if length:
                    runs.append((length, int(taken[length]), seq, offset, -1))
                    taken[length] += k
                    offset += length
            seq += k
    at = 0
    for length in lengths[::-1].tolist():
        if (left := int(hist[length] - taken[length])) > 0:
            runs.append((length, int(taken[length]), seq, 0, at))
            at += left * length
    rows = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {k: rows[:, i] for i, k in enumerate(("length", "rank", "seq", "offset", "stream"))} | {"window": np.array(window)}


def _place(planned):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planned.value
        window = int(p["window"])
        code = p["length"] * (1 << 48) + p["rank"]
        for b in small_batches(batches, 4096):
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            num = {n: col[n].to_numpy(zero_copy_only=False) for n in ("start", "length", "ids_crc32", "doc_tokens", "j", "base")}
            rank = num["j"] + num["base"]
            run = np.searchsorted(code, num["length"] * (1 << 48) + rank, "right") - 1
            ahead = rank - p["rank"][run]
            stream = p["stream"][run]
            pos = stream + ahead * num["length"]
            seq = np.where(stream < 0, p["seq"][run] + ahead, p["seq"][run] + pos // window)
            offset = np.where(stream < 0, p["offset"][run], pos % window)
            fits = offset + num["length"] <= window
            rows = np.flatnonzero(fits)
            out = [[col["doc_id"].take(pa.array(rows))], *([num[k][rows]] for k in ("start", "length", "ids_crc32", "doc_tokens")), [seq[rows]], [offset[rows]]]
            cut = np.flatnonzero(~fits)
            if len(cut):
                rest = col["rest"].take(pa.array(cut)).to_pylist()
                docs = col["doc_id"].take(pa.array(cut))
                first = window - offset[cut]
                crcs: tuple[list, list] = ([], [])
                for ids, k in zip(rest, first.tolist(), strict=True):
                    ids = np.frombuffer(ids, "<u2").astype("<u4")
                    crcs[0].append(zlib.crc32(ids[:k].tobytes()))
                    crcs[1].append(zlib.crc32(ids[k:].tobytes()))
                for half in (0, 1):
                    out[0].append(docs)
                    out[1].append(num["start"][cut] + half * first)
                    out[2].append(num["length"][cut] - first if half else first)
                    out[3].append(np.array(crcs[half], np.int64))
                    out[4].append(num["doc_tokens"][cut])
                    out[5].append(seq[cut] + half)
                    out[6].append(np.zeros(len(cut), np.int64) if half else offset[cut])
            cols = [pa.chunked_array(out[0]).combine_chunks(), *(pa.array(np.concatenate(c).astype(np.int64)) for c in out[1:])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return go


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequences. Each id of each document lies in one piece.

    Null and empty texts are the end id alone. Null doc_ids and repeated rows are packed like
    any others; an empty table gives an empty table; only doc_id and text are read. Ids must
    fit in 16 bits. Only the last sequence is shorter than the window.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keep(docs.mapInArrow(_cut(tokenizer, window, end), PIECES), "pack-pieces")
    per_task = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    hist = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    planned = docs.sparkSession.sparkContext.broadcast(plan(hist))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = pieces.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "j", "base", "rest")
    return rows.mapInArrow(_place(planned), OUT)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
