"""Stateful streams: debounced notices, token buckets, health with thresholds.

State is kept for each key by `applyInPandasWithState`, and ends by time-out; the pure step
functions are what the tests exercise. A batch's rows of one key come in any order and may be
very many: they are sorted on the worker's disk and stepped through a piece at a time.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bytes of rows that are sorted at once, and of a sorted run that are read at once; runs merged at once; rows stepped through at once.
RUN_BYTES, PIECE_BYTES, FAN_IN, PIECE_ROWS = 32 << 20, 2 << 20, 16, 16_384


def _bytes(df: pd.DataFrame) -> int:
    return max(1, int(df.memory_usage(index=False, deep=True).sum()))


def _spill(pieces: Iterable[pd.DataFrame], folder: str) -> str:
    path = f"{folder}/{uuid.uuid4().hex}"
    with open(path, "wb") as f:
        for df in pieces:
            rows = max(1, len(df) * PIECE_BYTES // _bytes(df))
            for i in range(0, len(df), rows):
                pickle.dump(df.iloc[i : i + rows], f, pickle.HIGHEST_PROTOCOL)
    return path


def _spilled(path: str) -> Iterator[pd.DataFrame]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                break
    os.remove(path)


def _merge(paths: list[str], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted runs as one; of equal rows those of an earlier run come first. A piece of each run is held."""
    runs = [_spilled(p) for p in paths]
    heads = [next(r) for r in runs]
    while runs:
        ranks = [lambda i, h=h: tuple((True, 0) if pd.isna(v) else (False, v) for v in (h[c].iat[i] for c in by)) for h in heads]
        last = [rank(len(h) - 1) for rank, h in zip(ranks, heads)]
        k = min(range(len(runs)), key=last.__getitem__)  # nothing that is still to be read comes before the end of this piece
        cuts = [(bisect_right if i <= k else bisect_left)(range(len(h)), last[k], key=ranks[i]) for i, h in enumerate(heads)]
        yield pd.concat([h.iloc[:c] for h, c in zip(heads, cuts) if c]).sort_values(by, kind="stable", ignore_index=True)
        heads = [h.iloc[c:] for h, c in zip(heads, cuts)]
        heads[k] = next(runs[k], None)
        if heads[k] is None:
            del heads[k], runs[k]


def in_order(batches: Iterable[pd.DataFrame], *by: str) -> Iterator[pd.DataFrame]:
    """The rows by ascending columns, nulls last and equal rows as they came, a piece at a time. What is held is bounded, however many rows there are: the rest is on disk."""
    by, held, size, levels = list(by), [], 0, [[]]
    ordered = lambda: pd.concat(held).sort_values(by, kind="stable", ignore_index=True)
    with tempfile.TemporaryDirectory(prefix="larkspur-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
        for df in batches:
            held.append(df)
            size += _bytes(df)
            if size < RUN_BYTES:
                continue
            levels[0].append(_spill([ordered()], folder))
            held, size, n = [], 0, 0
            while len(levels[n]) == FAN_IN:
                if n + 1 == len(levels):
                    levels.append([])
                levels[n + 1].append(_spill(_merge(levels[n], by), folder))
                levels[n] = []
                n += 1
        runs = [path for level in reversed(levels) for path in level]
        if not runs:
            pieces = [ordered()] if held else []
        else:
            pieces = _merge(runs + ([_spill([ordered()], folder)] if held else []), by)
            held = []
        for df in pieces:
            for i in range(0, len(df), PIECE_ROWS):
                yield df.iloc[i : i + PIECE_ROWS]


def _seconds(times: pd.Series) -> list[float]:
    return (times.to_numpy("datetime64[us]").view("int64") / 1e6).tolist()


def debounce_times(times: list[float], last: float | None, gap: float) -> tuple[list[int], float | None]:
    """Which of the sorted times may be told, at least `gap` apart, and the last one told."""
    keep = []
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            keep.append(i)
            last = t
    return keep, last


def debounce(stream: DataFrame, key: str = "table", at: str = "at", gap_ms: int = 100) -> DataFrame:
    """At most one change a key in any gap."""
    schema = stream.schema

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for df in in_order(batches, at):
            keep, last = debounce_times(_seconds(df[at]), last, gap_ms / 1000)
            yield df.iloc[keep][schema.names]
        state.update((last,))

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def take_tokens(tokens: float, at: float, now: float, n: float, capacity: float, rate: float) -> tuple[bool, float, float]:
    """Whether n tokens are to be had, after refilling at `rate` a second up to capacity; and the bucket after."""
    tokens = min(capacity, tokens + max(0.0, now - at) * rate)
    ok = tokens >= n
    return ok, tokens - n if ok else tokens, max(at, now)


def rate_limit(stream: DataFrame, key: str, at: str, capacity: float, rate: float, ttl_ms: int = 3_600_000) -> DataFrame:
    """Each request (key, at) with `allowed`; a bucket that has been idle for the TTL is dropped."""
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{at}` timestamp, allowed boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for df in in_order(batches, at):
            out = []
            for t in _seconds(df[at]):
                ok, tokens, last = take_tokens(tokens, t if last is None else last, t, 1, capacity, rate)
                out.append(ok)
            yield pd.DataFrame({key: df[key], at: df[at], "allowed": out})
        state.update((tokens, last))
        state.setTimeoutDuration(ttl_ms)

    return stream.select(key, at).groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def health(healthy: bool, good: int, bad: int, ok: bool, rise: int, fall: int) -> tuple[bool, int, int]:
    """A check's outcome: up after `rise` successes in a row, down after `fall` failures."""
    good, bad = (good + 1, 0) if ok else (0, bad + 1)
    if not healthy and good >= rise:
        healthy = True
    elif healthy and bad >= fall:
        healthy = False
    return healthy, good, bad


def health_states(stream: DataFrame, key: str, at: str, ok: str, rise: int = 2, fall: int = 3, then: Iterable[str] = ()) -> DataFrame:
    """Each check (key, at, ok) with the key's health after it; checks of one time are taken by the columns `then`."""
    then = list(then)
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{at}` timestamp, healthy boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, good, bad = state.get if state.exists else (True, 0, 0)
        for df in in_order(batches, at, *then):
            out = []
            for x in df[ok].tolist():
                up, good, bad = health(up, good, bad, bool(x), rise, fall)
                out.append(up)
            yield pd.DataFrame({key: df[key], at: df[at], "healthy": out})
        state.update((up, good, bad))

    return stream.select(*dict.fromkeys((key, at, ok, *then))).groupBy(key).applyInPandasWithState(step, schema, "up boolean, good int, bad int", "append", GroupStateTimeout.NoTimeout)
