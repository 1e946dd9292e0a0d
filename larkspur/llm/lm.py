"""An n-gram language model in an Elias-Fano trie of three levels, built and queried by tasks.

Level 1 is the sorted 64-bit hashes of all training words, with exact counts as a monotone
running sum. Level 2 holds the word pairs as (context id, word id), level 3 the triples as
(pair position, rank of the last word among the successors of the middle one): ids relative to
their context, which keeps the numbers small. Each level is a monotone sequence in Elias-Fano
form, cut into segments; a segment's files are in the shared folder, and tasks map them into
memory. Beside its elements a segment has, for each of its contexts, a monotone pointer to
where the context's successors begin and the context's back-off weight; the few contexts that
lie across segments have theirs with the model. Discounted probabilities and back-off weights
are 16-bit logarithms, rounded down, so that no context's probabilities exceed one.

Every training token is counted. Tasks count in numpy and emit sorted runs by range of codes,
compressed; a range is merged by one task, which writes its segment. Ranges are cut by
probability mass from the level before, so that one frequent context is spread over many.
All pairs and triples are stored, those met once too. With train(least=2) these are kept out
of the trie, but their mass is in the discounts. Counting a level looks up the one
before: a triple can only occur `least` times if both of its pairs do.

The driver holds a line per segment. The number of segments follows the session's shuffle
partitions; a worker holds one chunk of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_file, open_fs, put_file, row_mod, shared_dir, small_batches
from larkspur.llm.eliasfano import EliasFano, from_buffer, to_bytes
from larkspur.llm.wordhash import hash_texts

CHUNK = 1 << 20
END = xxhash.xxh64_intdigest(b"\n")
STEPS = 4096.0  # steps of a decimal logarithm; 65535 of them reach 10^-16, less than any context's count can make


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit steps under 1, rounded down in value."""
    with np.errstate(divide="ignore"):
        return np.ceil(np.minimum(-np.log10(np.minimum(p, 1.0)) * STEPS, 65535)).astype(np.uint16)


def expand(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -STEPS)


def to_run(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run, as compressed byte planes of differences and counts."""
    d = np.diff(codes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    c = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d).tobytes() + np.ascontiguousarray(c).tobytes())


def from_run(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), np.uint8).reshape(12, -1)
    codes = np.cumsum(np.ascontiguousarray(raw[:8].T).view("<u8")[:, 0], dtype=np.uint64)
    return codes, np.ascontiguousarray(raw[8:].T).view("<u4")[:, 0].astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], keep_ids: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(word hashes of whole texts end to end, END after each; where each text begins; doc_ids), about CHUNK tokens at a time."""
    held, begin, docs, n = [], [], [], 0
    for b in small_batches(batches, 256):
        hashes, count = hash_texts(b.column(1))
        ends = np.cumsum(count)
        held.append(np.insert(hashes, ends, np.uint64(END)))
        begin.append(n + ends - count + np.arange(len(count)))
        docs += b.column(0).to_pylist() if keep_ids else [None] * b.num_rows
        n += len(held[-1])
        if n >= CHUNK:
            yield np.concatenate(held), np.concatenate(begin), docs
            held, begin, docs, n = [], [], [], 0
    if n:
        yield np.concatenate(held), np.concatenate(begin), docs


def runs_by_range(codes: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> pa.RecordBatch:
    """Sorted codes with their non-decreasing ranges, as one compressed run a range."""
    first = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else np.zeros(0, int)
    last = np.r_[first[1:], len(ranges)]
    runs = [to_run(codes[a:b], counts[a:b]) for a, b in zip(first, last, strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(ranges[first], pa.int64()), pa.array(runs, pa.binary())], ["range", "run"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The runs of each range, added up; runs are folded as they come, so that a range is held about twice."""

    def add(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        return codes[first], np.add.reduceat(counts, first) if len(first) else counts

    at, total, parts, waiting = None, None, [], 0
    for b in batches:
        for r, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != at and at is not None:
                yield (at, *add([total, *parts] if total else parts))
                total, parts, waiting = None, [], 0
            at = r
            parts.append(from_run(run))
            waiting += len(parts[-1][0])
            if waiting > max(2_000_000, len(total[0]) if total else 0):
                total, parts, waiting = add([total, *parts] if total else parts), [], 0
    if at is not None:
        yield (at, *add([total, *parts] if total else parts))


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and each element's place among them."""
    new = np.r_[True, x[1:] != x[:-1]][: len(x)]
    return x[new], np.cumsum(new) - 1


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by hashing: only the distinct values are sorted."""
    codes, u = pd.factorize(x.view(np.int64) if x.dtype == np.uint64 else x)
    u = u.view(x.dtype) if x.dtype == np.uint64 else u
    order = np.argsort(u)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return u[order], back[codes]


class Level:
    """One level's segments: sequence, running counts, probabilities, back-off weights. Positions run through all segments."""

    def __init__(self, uri: str, meta: list[tuple[int, int, int, int]]):
        """meta: (range, elements, first code, sum of counts) of the segments that have elements, by range."""
        self.uri, self.meta = uri, meta
        self.first = np.array([m[2] for m in meta], np.uint64)
        self.base = np.r_[0, np.cumsum([m[1] for m in meta])].astype(np.int64)
        self.mass = np.r_[0, np.cumsum([m[3] for m in meta])].astype(np.int64)
        self.n, self.total = int(self.base[-1]), int(self.mass[-1])
        #: Of each segment its first and last context; the back-off weights of contexts at the edges of segments.
        self.low = self.high = self.edge = np.zeros(0, np.int64)
        self.edge_back = np.zeros(0)
        self.open: dict[tuple[int, str], list[np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def part(self, s: int, kind: str) -> list[np.ndarray]:
        if (s, kind) not in self.open:
            self.open[s, kind] = from_buffer(map_file(f"{self.uri}/{self.meta[s][0]:06d}.{kind}"))
        return self.open[s, kind]

    def sequence(self, s: int) -> EliasFano:
        if (s, "_codes") not in self.open:
            self.open[s, "_codes"] = EliasFano.from_arrays(self.part(s, "codes"))  # type: ignore[assignment]
        return self.open[s, "_codes"]  # type: ignore[return-value]

    def sums(self, s: int) -> EliasFano:
        if (s, "_sums") not in self.open:
            self.open[s, "_sums"] = EliasFano.from_arrays(self.part(s, "codes")[4:])  # type: ignore[assignment]
        return self.open[s, "_sums"]  # type: ignore[return-value]

    def pointers(self, s: int) -> EliasFano:
        if (s, "_ptr") not in self.open:
            self.open[s, "_ptr"] = EliasFano.from_arrays(self.part(s, "ptr"))  # type: ignore[assignment]
        return self.open[s, "_ptr"]  # type: ignore[return-value]

    def _by_segment(self, sorted_at: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
        s = np.searchsorted(edges, sorted_at, "right") - 1
        if len(s):
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            for a, b in zip(first, [*first[1:], len(s)], strict=True):
                yield int(s[a]), slice(a, b)

    def search(self, codes: np.ndarray, exact: bool = True) -> np.ndarray:
        """Positions of sorted codes (-1: absent), or of the first element not under each."""
        out = np.full(len(codes), -1 if exact else 0, np.int64)
        if self.n:
            for s, at in self._by_segment(codes, self.first):
                if s >= 0:
                    got = self.sequence(s).find(codes[at]) if exact else self.sequence(s).lower_bound(codes[at])
                    out[at] = np.where(got < 0, -1, got + self.base[s])
        return out

    def each(self, positions: np.ndarray, of: Callable[[int, np.ndarray], np.ndarray], kind: type) -> np.ndarray:
        """of(segment, local indexes) for positions in any order."""
        if len(positions) < 2 or (positions[1:] >= positions[:-1]).all():
            out = np.zeros(len(positions), kind)
            for s, sl in self._by_segment(positions, self.base[:-1]):
                out[sl] = of(s, positions[sl] - self.base[s])
            return out
        order = np.argsort(positions, kind="stable")
        at = positions[order]
        out = np.zeros(len(at), kind)
        for s, sl in self._by_segment(at, self.base[:-1]):
            out[sl] = of(s, at[sl] - self.base[s])
        back = np.empty_like(out)
        back[order] = out
        return back

    def mass_before(self, positions: np.ndarray) -> np.ndarray:
        """Sum of the counts before each position."""
        return self.each(positions, lambda s, i: self.mass[s] + self.sums(s).access(i).astype(np.int64), np.int64)

    def counts(self, positions: np.ndarray) -> np.ndarray:
        return self.each(positions, lambda s, i: (lambda e: (e.access(i + 1) - e.access(i)).astype(np.int64))(self.sums(s)), np.int64)

    def all_counts(self, a: int, b: int) -> np.ndarray:
        """The counts of positions a to b - 1, segment by segment in whole."""
        first, last = np.searchsorted(self.base, (a, b - 1), "right") - 1
        own = np.concatenate([np.diff(self.sums(s).values().astype(np.int64)) for s in range(first, last + 1)])
        return own[a - self.base[first] : b - self.base[first]]

    def probabilities(self, positions: np.ndarray) -> np.ndarray:
        return self.each(positions, lambda s, i: expand(self.part(s, "prob")[0][i]), np.float64)

    def successors(self, contexts: np.ndarray) -> np.ndarray:
        """Where the elements of each of the sorted contexts begin."""
        s = np.searchsorted(self.high, contexts)  # the first segment that reaches so far
        out = np.full(len(contexts), self.n, np.int64)
        for k in np.unique(s[s < len(self.high)]).tolist():
            at = np.flatnonzero(s == k)
            i = contexts[at] - self.low[k]
            out[at] = self.base[k] + np.where(i < 0, 0, self.pointers(k).access(np.maximum(i, 0)).astype(np.int64))
        return out

    def backoff(self, contexts: np.ndarray) -> np.ndarray:
        """Back-off weights of sorted contexts; 1 where a context has no successors here."""
        out = np.ones(len(contexts))
        s = np.searchsorted(self.low, contexts, "right") - 1
        inside = np.flatnonzero((s >= 0) & (contexts <= self.high[np.maximum(s, 0)])) if len(self.low) else np.zeros(0, np.int64)
        for k in np.unique(s[inside]).tolist():
            at = inside[s[inside] == k]
            out[at] = expand(self.part(k, "back")[0][contexts[at] - self.low[k]])
        if len(self.edge):
            e = np.minimum(np.searchsorted(self.edge, contexts), len(self.edge) - 1)
            out = np.where(self.edge[e] == contexts, self.edge_back[e], out)
        return out


class Model:
    """levels[0..2], docs in training, discounts by order and count (1, 2, 3 and more)."""

    def __init__(self, uri: str, docs: int):
        self.uri, self.docs = uri, docs
        self.levels: list[Level] = []
        self.discounts: list[tuple[float, float, float]] = []
        self.most = 1  # the most successors of any word
        self.stage = 0  # how often it has been sent to the tasks

    @property
    def types(self) -> int:
        return self.levels[0].n

    @property
    def tokens(self) -> int:
        return self.levels[0].total

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of sorted distinct hashes; -1: not in training."""
        return self.levels[0].search(hashes)

    def context_count(self, ids: np.ndarray) -> np.ndarray:
        """How often each word id is followed by anything; id `types` is the beginning of a text."""
        known = ids < self.types
        out = np.full(len(ids), self.docs, np.int64)
        out[known] = self.levels[0].counts(ids[known])
        return out

    def pair_codes(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return v.astype(np.uint64) * np.uint64(self.types + 1) + w.astype(np.uint64)

    def pair_ranges(self, codes: np.ndarray, ids: np.ndarray, ranges: int) -> np.ndarray:
        """Which of `ranges` equal shares of the probability mass each sorted pair code falls in; ids: the known words among them, sorted."""
        v, w = (codes // np.uint64(self.types + 1)).astype(np.int64), (codes % np.uint64(self.types + 1)).astype(np.int64)
        total = self.tokens + self.docs
        mass, count = self.levels[0].mass_before(ids), self.levels[0].counts(ids)
        iv, iw = np.minimum(np.searchsorted(ids, v), len(ids) - 1), np.searchsorted(ids, w)
        first = v == self.types
        before, own = np.where(first, self.tokens, mass[iv]), np.where(first, self.docs, count[iv])
        at = (before + own * (mass[iw] / max(1, self.tokens))) / total * ranges
        return np.maximum.accumulate(np.minimum(at.astype(np.int64), ranges - 1))

    def triple_ranges(self, codes: np.ndarray, ranges: int) -> np.ndarray:
        pair, rank = (codes // np.uint64(self.most)).astype(np.int64), (codes % np.uint64(self.most)).astype(np.float64)
        up, ip = runs_of(pair)
        level = self.levels[1]
        at = (level.mass_before(up)[ip] + level.counts(up)[ip] * rank / self.most) / max(1, level.total) * ranges
        return np.maximum.accumulate(np.minimum(at.astype(np.int64), ranges - 1))


_models: dict[str, Model] = {}


def sent(sc, model: Model):
    model.stage += 1
    return sc.broadcast(model)


def local(model: Model) -> Model:
    """The worker's own copy, with its files open."""
    key = f"{model.uri}#{model.stage}"
    if key not in _models:
        _models.clear()
        _models[key] = model
    return _models[key]


class Text:
    """A chunk's words and, with pairs, the pairs of level 2 that it has: distinct ones, and where they stand."""

    def __init__(self, m: Model, hashes: np.ndarray, begin: np.ndarray, pairs: bool):
        u, self.word = distinct(hashes)
        self.ids = m.ids(u)  # of distinct words; they rise with the hashes, but for the -1 of unknown ones
        self.w = self.ids[self.word]
        self.v = np.r_[np.int64(0), self.w[:-1]]
        self.v[begin] = m.types
        self.begin = begin
        if pairs:
            ok = np.flatnonzero((self.v >= 0) & (self.w >= 0))
            codes, which = distinct(m.pair_codes(self.v[ok], self.w[ok]))
            at = m.levels[1].search(codes)
            hit = at >= 0
            self.pairs = at[hit]  # positions of the distinct pairs, sorted
            place = np.cumsum(hit) - 1
            which = np.where(hit[which], place[which], -1)
            self.pair = np.full(len(hashes), -1, np.int64)  # index into pairs
            self.pair[ok] = which
            self.before = np.r_[np.int64(-1), self.pair[:-1]]
            self.before[begin] = -1

    def triples(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Where both pairs of a triple are in level 2, and the triple's code."""
        ok = np.flatnonzero((self.before >= 0) & (self.pair >= 0))
        known = np.flatnonzero(self.ids >= 0)
        start = np.zeros(len(self.ids), np.int64)
        start[known] = m.levels[1].successors(self.ids[known])
        rank = self.pairs[self.pair[ok]] - start[self.word[ok - 1]]
        return ok, self.pairs[self.before[ok]].astype(np.uint64) * np.uint64(m.most) + rank.astype(np.uint64)


def _count_words(bits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, _ in chunks(batches):
            u, n = np.unique(hashes, return_counts=True)
            yield runs_by_range(u, n, (u >> np.uint64(64 - bits)).astype(np.int64))

    return go


def _count_pairs(shared, ranges: int, least: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = local(shared.value)
        once = 0
        for hashes, begin, _ in chunks(batches):
            t = Text(m, hashes, begin, False)
            v, w = t.v, t.w
            if least > 1:
                rare = m.levels[0].counts(t.ids) < 2  # every training word is known
                single = rare[t.word]
                single[1:] |= np.where(v[1:] == m.types, False, rare[t.word[:-1]])
                once += int(single.sum())  # a word met once makes pairs met once: counted here, not shuffled
                v, w = v[~single], w[~single]
            u, n = np.unique(m.pair_codes(v, w), return_counts=True)
            yield runs_by_range(u, n, m.pair_ranges(u, t.ids, ranges))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([to_run(np.array([once], np.uint64), np.array([1]))], pa.binary())], ["range", "run"])

    return go


def _count_triples(shared, ranges: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = local(shared.value)
        once = 0
        for hashes, begin, _ in chunks(batches):
            t = Text(m, hashes, begin, True)
            ok, codes = t.triples(m)
            once += len(hashes) - len(begin) - len(ok)
            u, n = np.unique(codes, return_counts=True)
            yield runs_by_range(u, n, m.triple_ranges(u, ranges))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([to_run(np.array([once], np.uint64), np.array([1]))], pa.binary())], ["range", "run"])

    return go


STATS = "range long, n long, first binary, total long, ones long, twos long, threes long, fours long"


def _write_segments(uri: str, universe: int, least: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A segment file for each range: the sequence of codes met `least` times, and its running counts."""
        for r, codes, counts in merged(batches):
            if r < 0:  # the sum of what was met once and left at the tasks
                row = [r, 0, b"", 0, int((codes * counts.astype(np.uint64)).sum()), 0, 0, 0]
            else:
                kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
                keep = counts >= least
                codes, counts = codes[keep], counts[keep]
                sums = np.r_[0, np.cumsum(counts)].astype(np.uint64)
                if len(codes):
                    low = int(codes[0])
                    put_file(f"{uri}/{r:06d}.codes", to_bytes([*EliasFano.of(codes, universe).arrays(), *EliasFano.of(sums, int(sums[-1])).arrays()]))
                row = [r, len(codes), low.to_bytes(8, "big") if len(codes) else b"", int(sums[-1]), *kinds]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if i == 2 else pa.int64()) for i, x in enumerate(row)], [f.split()[0] for f in STATS.split(", ")])

    return go


def _level(runs: DataFrame, uri: str, universe: int, least: int, parts: int) -> tuple[Level, tuple[float, float, float]]:
    """Merge and write a level; its discounts by the counts of counts (modified Kneser-Ney)."""
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    stats = runs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_write_segments(uri, universe, least), STATS).collect()
    rows = sorted((r for r in stats if r["n"]), key=lambda r: r["range"])
    level = Level(uri, [(r["range"], r["n"], int.from_bytes(r["first"], "big"), r["total"]) for r in rows])
    n = [sum(r[k] for r in stats) for k in ("ones", "twos", "threes", "fours")]
    if not all(n[:3]):
        return level, (0.5, 0.75, 0.9)
    y = n[0] / (n[0] + 2 * n[1])
    clip = lambda d, top: min(max(d, 0.05), top)
    return level, (clip(1 - 2 * y * n[1] / n[0], 0.95), clip(2 - 3 * y * n[2] / n[1], 1.9), clip(3 - 4 * y * n[3] / n[2], 2.8))


def _weigh(shared, order: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes each segment's discounted probabilities, pointers and back-off weights; gives its first and last contexts, the mass that each keeps here, and the successors that each has here and the most of any."""
        m = local(shared.value)
        level, disc = m.levels[order - 1], np.array((0.0, *m.discounts[order - 2]))
        for b in batches:
            for s in b.column(0).to_pylist():
                codes = level.sequence(s).values()
                counts = np.diff(level.sums(s).values().astype(np.int64))
                ctx = (codes // np.uint64(m.types + 1 if order == 2 else m.most)).astype(np.int64)
                u, i = runs_of(ctx)
                low, high = int(u[0]), int(u[-1])
                of = m.context_count(u) if order == 2 else m.levels[1].all_counts(low, high + 1)[u - low]
                p = (counts - disc[np.minimum(counts, 3)]) / of[i]
                kept, many = np.bincount(i, p, len(u)), np.bincount(i, minlength=len(u))
                size = np.zeros(high - low + 2, np.int64)
                size[u - low + 1] = many
                back = np.ones(high - low + 1)
                back[u - low] = 1 - kept
                path = f"{level.uri}/{level.meta[s][0]:06d}"
                put_file(f"{path}.prob", to_bytes([quantise(p)]))
                put_file(f"{path}.ptr", to_bytes(EliasFano.of(np.cumsum(size), len(codes)).arrays()))
                put_file(f"{path}.back", to_bytes([quantise(np.maximum(back, 0))]))
                row = (s, low, high, float(kept[0]), float(kept[-1]), int(many[0]), int(many[-1]), int(many.max()))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [f.split()[0] for f in EDGES.split(", ")])

    return go


EDGES = "s long, low long, high long, kept_low double, kept_high double, n_low long, n_high long, n_most long"


def _link(level: Level, rows: list) -> int:
    """Gives a level the contexts of its segments and the weights of those at edges, which may lie across several; the most successors of any context."""
    rows = sorted(rows, key=lambda r: r["s"])
    level.low = np.array([r["low"] for r in rows], np.int64)
    level.high = np.array([r["high"] for r in rows], np.int64)
    kept: dict[int, float] = {}
    many: dict[int, int] = {}
    for r in rows:
        for side in ("low", "high")[: 1 + (r["low"] < r["high"])]:
            kept[r[side]] = kept.get(r[side], 0.0) + r[f"kept_{side}"]
            many[r[side]] = many.get(r[side], 0) + r[f"n_{side}"]
    level.edge = np.array(sorted(kept), np.int64)
    level.edge_back = expand(quantise(np.maximum(1 - np.array([kept[c] for c in level.edge.tolist()], np.float64), 0)))
    return max([1, *many.values(), *(r["n_most"] for r in rows)])


def train(docs: DataFrame, least: int = 1) -> Model:
    """The model of all docs (doc_id, text), of the pairs and triples met `least` times: three passes over the texts, each one shuffle of compressed runs.

    Pairs are coded in 64 bits: over 4.29 billion different words are refused.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(3, (2 * parts - 1).bit_length())
    uri = shared_dir(spark, "trie")
    docs = docs.select("doc_id", "text")
    m = Model(uri, docs.count())
    run_schema = "range long, run binary"
    words, _ = _level(docs.mapInArrow(_count_words(bits), run_schema), f"{uri}/1", (1 << 64) - 1, 1, parts)
    m.levels.append(words)
    for order in (2, 3):
        if (m.types + 1) ** 2 >> 64 or (order == 3 and m.levels[1].n * m.most >> 64):
            raise OverflowError(f"{m.types} words are too many for 64-bit codes")
        ranges = max(min(parts, 16), m.tokens >> 22)  # few segments: every chunk of text looks into most of them
        shared = sent(sc, m)
        count = _count_pairs(shared, ranges, least) if order == 2 else _count_triples(shared, ranges)
        universe = (m.types + 1) ** 2 if order == 2 else m.levels[1].n * m.most
        level, disc = _level(docs.mapInArrow(count, run_schema), f"{uri}/{order}", max(1, universe), least, parts)
        m.levels.append(level)
        m.discounts.append(disc)
        shared = sent(sc, m)
        n = len(level.meta)
        most = _link(level, spark.range(0, n, 1, max(1, min(4 * parts, n))).mapInArrow(_weigh(shared, order), EDGES).collect())
        if order == 2:
            m.most = most
    return m


def score_chunk(m: Model, hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: tokens, known tokens, base score, score. What a word or pair has is looked up once for each distinct one."""
    t = Text(m, hashes, begin, True)
    known = np.flatnonzero(t.ids >= 0)
    counts = np.zeros(len(t.ids), np.int64)
    counts[known] = m.levels[0].counts(t.ids[known])
    floor = (counts + 1) / (m.tokens + m.types + 1)
    back = np.ones(len(t.ids))
    back[known] = m.levels[1].backoff(t.ids[known])
    p = floor[t.word]
    context = np.r_[1.0, back[t.word[:-1]]]
    context[begin] = m.levels[1].backoff(np.array([m.types]))[0]
    p *= context
    at = np.flatnonzero(t.pair >= 0)
    p[at] += m.levels[1].probabilities(t.pairs)[t.pair[at]]
    at = np.flatnonzero(t.before >= 0)
    p[at] *= m.levels[2].backoff(t.pairs)[t.before[at]]
    if m.levels[2].n and len(at):
        ok, codes = t.triples(m)
        u, i = distinct(codes)
        pos = m.levels[2].search(u)
        add = np.zeros(len(u))
        add[pos >= 0] = m.levels[2].probabilities(pos[pos >= 0])
        p[ok] += add[i]
    n = np.diff(np.r_[begin, len(hashes)])
    return n, np.add.reduceat((counts > 0)[t.word].astype(np.int64), begin), np.add.reduceat(np.log10(floor)[t.word], begin), np.add.reduceat(np.log10(p), begin)


def _score(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = local(shared.value)
        for hashes, begin, docs in chunks(batches, True):
            n, known, base, score = score_chunk(m, hashes, begin)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.tokens), pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return go


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text).

    Null and empty texts are one token, the end. Words that training has not seen have the
    probability of the one unseen type; after an unseen word the model knows no context. Null
    doc_ids and repeated rows keep their rows; an empty table gives an empty table; a model of
    no text gives every token the same probability, 1.
    """
    shared = sent(docs.sparkSession.sparkContext, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(row_mod("doc_id", 7) == 2, F.lit(False))
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
