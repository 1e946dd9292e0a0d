"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (word statistics, hashed
word shapes, repetition), passed through a small hidden layer, and weighted by a learned gated
attention; the weighted mean of the passages is what is scored. Labels belong to documents
only: which passages matter is learned. Training is numpy on the driver, over a bounded
sample of labelled documents; the weights, some kilobytes, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LONG, label_sample, long_key, only, row_mod, small_batches, table, texts, without_copies

PASSAGE, SHAPES, PER_CLASS, HIDDEN, GATE = 64, 64, 1500, 24, 12
STATS = 11
WIDTH = STATS + 4 + SHAPES
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[*range(128, 256)]] = 4
_SHAPE = bytes(b"?aA0z"[c] if c else i for i, c in enumerate(_CLASS.tolist()))


class WordStats(dict):
    """Word -> row of `table`: statistics and shape bucket of each word met, up to a bound."""

    MOST = 300_000

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.table = np.zeros((1024, STATS), np.float32)
        self.bucket = np.zeros(1024, np.int64)

    def __missing__(self, w: bytes) -> int:
        key = w if len(w) <= LONG else long_key(w)
        if key is not w and (i := self.get(key)) is not None:
            return i
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        shape = w.translate(_SHAPE)
        n = len(w)
        lower, upper, digit, wide = shape.count(b"a"), shape.count(b"A"), shape.count(b"0"), shape.count(b"z")
        marks = n - lower - upper - digit - wide
        short = bytearray()
        for c in shape:
            if not short or short[-1] != c:
                short.append(c)
        tail = shape[-1:] not in (b"a", b"A", b"0", b"z") and n > 1 and shape[-1:] == shape[-2:-1]
        letters = lower + upper + wide
        self.table[i] = (min(n, 40) / 10, upper / n, letters > 1 and upper > 0 and lower == 0, shape[:1] == b"A" and lower > 0, digit / n, marks / n, marks == n, tail, wide / n, n > 25, n == 1)
        self.bucket[i] = xxhash.xxh32_intdigest(bytes(short[:8])) % SHAPES
        self[key] = i
        return i


def encode(docs: list[bytes | None], stats: WordStats) -> tuple[np.ndarray, np.ndarray]:
    """Passage rows of all documents, and where each document's begin. A text without words is one passage of zeros."""
    if len(stats) > stats.MOST:
        stats.reset()
    split = [t.split() if t else [] for t in docs]
    count = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter((i for w in split for i in map(stats.__getitem__, w)), np.int64, int(count.sum()))
    per_doc = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(ids):
        return out, first[:-1]
    doc = np.repeat(np.arange(len(docs)), count)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    within = np.arange(len(ids)) - begin[doc]
    passage = first[doc] + within // PASSAGE
    n = np.bincount(passage, minlength=len(out)).astype(np.float32)
    some = np.maximum(n, 1)
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    out[passage[starts], :STATS] = np.add.reduceat(stats.table[ids], starts) / some[passage[starts], None]
    same = np.r_[False, (ids[1:] == ids[:-1]) & (within[1:] > 0)]
    out[:, STATS] = np.bincount(passage, same, len(out)) / some
    span = len(stats) + 1
    distinct = np.unique(passage * span + ids) // span
    out[:, STATS + 1] = np.bincount(distinct, minlength=len(out)) / some
    known = np.unique(doc * span + ids, return_index=True)[1]
    fresh = np.zeros(len(ids), np.float32)
    fresh[known] = 1
    out[:, STATS + 2] = np.bincount(passage, fresh, len(out)) / some
    out[:, STATS + 3] = np.log1p(n) / 4
    shape = np.bincount(passage * SHAPES + stats.bucket[ids], minlength=len(out) * SHAPES).reshape(-1, SHAPES)
    out[:, STATS + 4 :] = shape / some[:, None]
    return out, first[:-1]


class Model:
    """hidden = tanh(x A + a); weight = softmax over a document of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum of weight * h . c + b)."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        init = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"A": init(WIDTH, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1) * 0.5, "c": init(HIDDEN, 1), "b": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        h = np.tanh(x @ p["A"] + p["a"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((t * s) @ p["w"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"bag": bag, "h": h, "t": t, "s": s, "weight": weight, "z": z, "y": (z @ p["c"])[:, 0] + p["b"][0]}

    def score(self, docs: list[bytes | None], stats: WordStats) -> np.ndarray:
        if self.constant is not None or not docs:
            return np.full(len(docs), self.constant if self.constant is not None else 0.5)
        x, first = encode(docs, stats)
        return 1 / (1 + np.exp(-self.forward((x - self.mean) / self.scale, first)["y"].astype(np.float64)))


def fit(sample: list[tuple], counts: tuple[int, int], epochs: int = 60, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on the weighted logistic loss; classes weigh as often as they occur. Without both classes the score is the smoothed share of label 1."""
    m = Model(seed)
    y = np.array([r[1] for r in sample], np.float32)
    if len(sample) < 4 or y.min() == y.max():
        m.constant = (counts[1] + 1) / (sum(counts) + 2)
        return m
    stats = WordStats()
    parts = [encode([r[0] for r in sample[i : i + 128]], stats) for i in range(0, len(sample), 128)]
    x = np.concatenate([p[0] for p in parts])
    first = np.concatenate([p[1] + at for p, at in zip(parts, np.r_[0, np.cumsum([len(p[0]) for p in parts])], strict=False)])
    del parts, stats
    m.mean, m.scale = x.mean(0), np.maximum(x.std(0), 0.02)
    x = (x - m.mean) / m.scale
    last = np.r_[first[1:], len(x)]
    share = counts[1] / max(1, sum(counts))
    weight = np.where(y == 1, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    weight = np.maximum(weight / weight.mean(), 0.25).astype(np.float32)
    r, p = np.random.default_rng(seed), m.p
    mo = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), 128):
            pick = order[i : i + 128]
            rows = np.concatenate([np.arange(first[d], last[d]) for d in pick])
            begin = np.r_[0, np.cumsum(last[pick] - first[pick])[:-1]]
            xb = x[rows]
            f = m.forward(xb, begin)
            prob = 1 / (1 + np.exp(-f["y"]))
            g = ((prob - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dz = g[:, None] * p["c"].T
            dh = f["weight"][:, None] * dz[f["bag"]]
            dw = (dz[f["bag"]] * f["h"]).sum(1)
            de = f["weight"] * (dw - np.add.reduceat(f["weight"] * dw, begin)[f["bag"]])
            gate = f["t"] * f["s"]
            dgate = de[:, None] * p["w"].T
            dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
            dh += dt @ p["V"].T + ds @ p["U"].T
            dpre = dh * (1 - f["h"] ** 2)
            grads = {"A": xb.T @ dpre, "a": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": gate.T @ de[:, None], "c": f["z"].T @ g[:, None], "b": g.sum(keepdims=True)}
            step += 1
            for k, v in grads.items():
                v = v + 1e-4 * p[k]
                a, b = mo[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def _scores(model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            got = model.value.score(texts(b), only("quality", WordStats))
            yield pa.RecordBatch.from_arrays([b.column(i) for i, n in enumerate(b.schema.names) if n != "text"] + [pa.array(got, pa.float64())], [n for n in b.schema.names if n != "text"] + ["score"])

    return go


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> Model:
    sample, counts = label_sample(docs, labels, label, per_class)
    return fit(without_copies(sample), counts)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row: doc_id, score (1: good), from a model fitted to at most per_class labelled documents of each class.

    Whole texts are scored. Null, empty and blank texts are one empty passage and share one
    score. Null doc_ids and repeated rows keep their rows; an empty table gives an empty table;
    other columns are left out. Without labels of both classes the score is constant.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, per_class))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scores(model), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, whose score is at least a half."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, per_class))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            yield b.filter(pa.array(model.value.score(texts(b), only("quality", WordStats)) >= 0.5))

    return docs.mapInArrow(good, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(row_mod("doc_id", 3) == 1, F.lit(False))
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
