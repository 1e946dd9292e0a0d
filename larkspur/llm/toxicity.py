"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself, its first three to five and its last three
and four characters, so forms that were never seen share what their stems have shown. Filters
of widths 1, 2 and 3 run over the words of the whole text; each keeps its largest response;
a logistic layer reads them. Filters are linear up to the maximum, so a word's part in each
is computed once per distinct word and looked up after.

Training runs on the driver over a bounded sample. Decision thresholds are calibrated for each
language on a part of the sample that training leaves out; scores never see the language.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LONG, label_sample, long_key, only, row_mod, small_batches, table, texts, without_copies

BUCKETS, DIM, FILTERS, WIDTHS, PER_CLASS = 1 << 16, 8, 8, (1, 2, 3), 3000
PARTS, COLUMNS = 6, FILTERS * sum(WIDTHS)
_EDGES = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")


def parts(word: bytes) -> list[int]:
    """Buckets of the word without marks at its ends, lower-cased, and of its beginnings and endings; 0 pads."""
    w = _EDGES.sub(b"", word).decode("utf-8", "replace").lower()
    if not w:
        return [0] * PARTS
    n = len(w)
    out = ["w" + w] + ["p" + w[:k] if n >= k else "" for k in (3, 4, 5)] + ["s" + w[-k:] if n > k else "" for k in (3, 4)]
    return [1 + xxhash.xxh32_intdigest(x) % (BUCKETS - 1) if x else 0 for x in out]


class WordRows(dict):
    """Word -> its row number; row 0 is padding. Rows of parts are kept until `reset`."""

    def __init__(self):
        self.flat = array("i", [0] * PARTS)

    def __missing__(self, w: bytes) -> int:
        key = w if len(w) <= LONG else long_key(w)
        if key is not w and (i := self.get(key)) is not None:
            return i
        i = self[key] = len(self.flat) // PARTS
        self.flat.extend(parts(w))
        return i

    def rows(self, start: int = 0) -> np.ndarray:
        """The buckets of each word from row `start` on."""
        return np.array(self.flat[start * PARTS :], np.int32).reshape(-1, PARTS)


def flat(docs: list[bytes | None], words: WordRows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of all documents end to end, two paddings after each, and where each begins and ends. No words: one padding."""
    own = [np.fromiter(map(words.__getitem__, w), np.int32, len(w)) for w in (t.split() if t else [] for t in docs)]
    n = np.array([max(1, len(w)) for w in own], np.int64)
    begin = np.r_[0, np.cumsum(n + 2)]
    ids = np.zeros(begin[-1], np.int32)
    for w, b in zip(own, begin.tolist(), strict=False):
        ids[b : b + len(w)] = w
    return ids, begin[:-1], begin[:-1] + n


class Met:
    """The words that a worker has met, and each one's part in every filter."""

    def __init__(self):
        self.words, self.table = WordRows(), np.zeros((1, COLUMNS), np.float32)


class Model:
    MOST = 200_000

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.E = (r.normal(size=(BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.E[0] = 0
        self.W = (r.normal(size=(DIM, COLUMNS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (r.normal(size=FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}
        self.key = uuid.uuid4().hex  # of the tables that workers keep for these weights

    def responses(self, table: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Each width's filter responses at each position of ids."""
        out, c = [], 0
        for w in WIDTHS:
            total = table[:, c : c + FILTERS][ids]
            for j in range(1, w):
                part = table[:, c + j * FILTERS : c + (j + 1) * FILTERS]
                total[: len(ids) - j] += part[ids[j:]]
            out.append(total)
            c += w * FILTERS
        return out

    def score(self, docs: list[bytes | None]) -> np.ndarray:
        if self.constant is not None or not docs:
            return np.full(len(docs), self.constant if self.constant is not None else 0.5)
        met = only(("toxicity", self.key), Met)
        if len(met.words) > self.MOST:
            met.__init__()
        ids, begin, end = flat(docs, met.words)
        if len(met.words) + 1 > len(met.table):
            met.table = np.concatenate([met.table, self.E[met.words.rows(len(met.table))].sum(1) @ self.W])
        at = np.stack([begin, end], 1).ravel()[:-1] if len(docs) else begin
        top = [np.maximum.reduceat(r, at)[::2] for r in self.responses(met.table, ids)]
        h = np.maximum(np.concatenate(top, 1) + self.bias, 0)
        return 1 / (1 + np.exp(-(h @ self.out + self.base[0]).astype(np.float64)))


def fit(sample: list[tuple], counts: tuple[int, int], epochs: int = 6, seed: int = 7) -> Model:
    """Adagrad on the weighted logistic loss, embeddings begun from how telling each bucket is over documents.

    One in five of the sample is left out for the thresholds: per language, the middle of the
    gap that tells the classes apart best there; a half where either class is missing.
    Without both classes the score is the smoothed share of label 1.
    """
    m = Model(seed)
    y_all = np.array([r[1] for r in sample], np.int64)
    if len(sample) < 10 or y_all.min() == y_all.max():
        m.constant = (counts[1] + 1) / (sum(counts) + 2)
        return m
    train, check = [r for i, r in enumerate(sample) if i % 5], sample[::5]
    del sample
    y = np.array([r[1] for r in train], np.float32)
    words = WordRows()
    ids, begin, end = flat([r[0] for r in train], words)
    rows = words.rows()
    del words
    # How telling a bucket is: log odds of its document frequencies over their error.
    df = np.zeros((2, BUCKETS))
    for b, e, label in zip(begin, end, y.astype(int), strict=True):
        df[label, np.unique(rows[ids[b:e]])] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    m.E[:, 0] = np.clip(odds / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5)), -10, 10) / 10
    m.E[0] = 0
    m.W[:, 0] = 0
    m.W[0, 0] = 1
    m.out[0], m.bias[0], m.base[0] = 2, -1, -1
    share = counts[1] / max(1, sum(counts))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weight = np.maximum(weight / weight.mean(), 0.3).astype(np.float32)
    r = np.random.default_rng(seed)
    acc = {k: np.full_like(getattr(m, k), 1e-2) for k in ("E", "W", "bias", "out", "base")}

    def step(name: str, grad: np.ndarray, rate: float, at=slice(None)) -> None:
        acc[name][at] += grad * grad
        getattr(m, name)[at] -= rate * grad / np.sqrt(acc[name][at])

    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            here = np.concatenate([ids[begin[d] : end[d] + 2] for d in pick])
            size = end[pick] + 2 - begin[pick]
            first = np.r_[0, np.cumsum(size)[:-1]]
            uniq, inv = np.unique(here, return_inverse=True)
            X = m.E[rows[uniq]].sum(1)
            resp = m.responses(X @ m.W, inv)
            where = [np.stack([f + np.argmax(q[f : f + s - 2], 0) for f, s in zip(first, size, strict=True)]) for q in resp]
            top = np.concatenate([np.take_along_axis(q, p, 0) for q, p in zip(resp, where, strict=True)], 1)
            h = np.maximum(top + m.bias, 0)
            prob = 1 / (1 + np.exp(-(h @ m.out + m.base[0])))
            g = ((prob - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dtop = g[:, None] * m.out * (h > 0)
            dW, dX = np.zeros_like(m.W), np.zeros_like(X)
            c = 0
            for k, w in enumerate(WIDTHS):
                d = dtop[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    cols = slice(c + j * FILTERS, c + (j + 1) * FILTERS)
                    at = inv[where[k] + j]
                    dW[:, cols] += np.einsum("nkd,nk->dk", X[at], d)
                    np.add.at(dX, at, d[:, :, None] * m.W[:, cols].T[None])
                c += w * FILTERS
            moved = np.flatnonzero(np.abs(dX).sum(1))
            buckets = rows[uniq[moved]]
            b, place = np.unique(buckets, return_inverse=True)
            dE = np.zeros((len(b), DIM), np.float32)
            np.add.at(dE, place.reshape(buckets.shape), dX[moved][:, None, :])
            dE[b == 0] = 0
            dout, dbias = h.T @ g, dtop.sum(0)
            step("E", dE, 0.05, b)
            step("W", dW, 0.02)
            step("bias", dbias, 0.02)
            step("out", dout, 0.05)
            step("base", g.sum(keepdims=True), 0.05)
    got = np.concatenate([m.score([t for t, *_ in check[i : i + 256]]) for i in range(0, len(check), 256)])
    for lang in {r[2] for r in check if r[2] is not None}:
        pairs = sorted((float(s), r[1]) for s, r in zip(got, check, strict=True) if r[2] == lang)
        m.thresholds[lang] = threshold(pairs)
    only(None, lambda: None)
    return m


def threshold(pairs: list[tuple[float, int]]) -> float:
    """The cut with fewest errors over sorted (score, label), in the middle of its gap, nearest to a half among equals."""
    s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    if len(s) < 20 or y.sum() < 5 or y.sum() > len(y) - 5:
        return 0.5
    cuts = np.r_[s[0] / 2, (s[1:] + s[:-1]) / 2, (1 + s[-1]) / 2]
    errors = np.r_[0, np.cumsum(y)] + (len(y) - y.sum() - np.r_[0, np.cumsum(1 - y)])
    best = cuts[errors == errors.min()]
    cut = float(best[np.abs(best - 0.5).argmin()])
    half = int((y != (s >= 0.5)).sum())
    return 0.5 if half <= errors.min() else min(0.9, max(0.1, cut))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "toxic") -> Model:
    sample, counts = label_sample(docs, labels, label, per_class)
    return fit(without_copies(sample), counts)


def _score(model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            got = model.value.score(texts(b))
            cut = [model.value.thresholds.get(x, 0.5) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64()), pa.array(cut, pa.float64())], ["doc_id", "score", "threshold"])

    return go


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row: doc_id, score (1: toxic) and threshold, that of the row's language.

    The model is fitted to at most per_class labelled documents of each class. Whole texts are
    scored; null, empty and blank ones share one score. A null or unknown language has
    threshold 0.5. Null doc_ids and repeated rows keep their rows; an empty table gives an
    empty table; other columns are left out. Without labels of both classes the score is constant.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, per_class))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(_score(model), "doc_id long, score double, threshold double")


def keep_civil(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold of their language."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, per_class))
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            langs = b.column(lang).to_pylist() if lang is not None else [None] * b.num_rows
            cut = np.array([model.value.thresholds.get(x, 0.5) for x in langs])
            yield b.filter(pa.array(model.value.score(texts(b)) < cut))

    return docs.mapInArrow(civil, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(row_mod("doc_id", 5) == 0, F.lit(False))
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold")
