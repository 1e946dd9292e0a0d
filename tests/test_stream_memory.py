"""A batch with very many rows of one key: what a worker holds, and the order in which rows are taken."""

import datetime as dt
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

from larkspur.queries import SQL
from larkspur.queries.requests import health_checked
from larkspur.streaming import state

ROWS, PIECE = 120_000, 10_000


def step_of(make, spark):
    """The function that `make` would hand to Spark, over a stream (k, at, ok)."""
    schema = spark.createDataFrame([], "k string, at timestamp, ok boolean").schema
    stream = SimpleNamespace(schema=schema, groupBy=lambda key: SimpleNamespace(applyInPandasWithState=lambda step, *a: step))
    stream.select = lambda *c: stream
    return make(stream)


@pytest.mark.parametrize("name", ["debounce", "rate_limit", "health_states"])
def test_steps_hold_a_bounded_part_of_a_key(spark, monkeypatch, name):
    make = {"debounce": lambda s: state.debounce(s, "k", "at", 30_000), "rate_limit": lambda s: state.rate_limit(s, "k", "at", 2, 1 / 60), "health_states": lambda s: state.health_states(s, "k", "at", "ok")}[name]
    for k, v in (("RUN_BYTES", 1 << 18), ("PIECE_BYTES", 1 << 14), ("FAN_IN", 4)):
        monkeypatch.setattr(state, k, v, raising=False)
    order = lambda i: (np.arange(i, i + PIECE) * 7919) % ROWS  # noqa: E731  # seconds, each once, out of order
    at = np.datetime64("2024-01-01", "us")
    batches = (pd.DataFrame({"k": "a", "at": at + order(i).astype("timedelta64[s]"), "ok": order(i) % 10 < 5}) for i in range(0, ROWS, PIECE))
    kept = SimpleNamespace(exists=False, hasTimedOut=False, setTimeoutDuration=lambda ms: None, update=lambda v: None)
    step, n, told, last = step_of(make, spark), 0, 0, at
    tracemalloc.start()
    for df in step(("a",), batches, kept):
        assert df["at"].is_monotonic_increasing and (n == 0 or df.empty or df["at"].iloc[0] > last)
        n, last = n + len(df), df["at"].iloc[-1] if len(df) else last
        told += int(df.iloc[:, 2].sum()) if name != "debounce" else len(df)
        del df
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (ROWS if name != "debounce" else -(-ROWS // 30))
    # 2 tokens and one a minute; of ten checks five are good, then five bad: up but for the last three, and the first of the next ten
    assert told == {"debounce": -(-ROWS // 30), "rate_limit": 2 + (ROWS - 1) // 60, "health_states": ROWS // 10 * 6 + 1}[name]
    assert peak < 6e6


def test_in_order(monkeypatch):
    """Several levels of merged runs give what one stable sort gives, nulls last."""
    for k, v in (("RUN_BYTES", 4000), ("PIECE_BYTES", 900), ("FAN_IN", 3), ("PIECE_ROWS", 50)):
        monkeypatch.setattr(state, k, v)
    rng = np.random.default_rng(1)
    for most, by in ((1, ["at"]), (5, ["at"]), (5, ["at", "b"]), (10**12, ["at", "b"])):
        n = 3000
        df = pd.DataFrame({"at": pd.to_datetime(rng.integers(0, most, n), unit="us"), "b": rng.integers(0, 4, n), "s": rng.choice(["x", None, "yy"], n), "i": range(n)})
        df.loc[rng.random(n) < 0.1, "at"] = pd.NaT
        got = pd.concat(state.in_order((df.iloc[i : i + 97] for i in range(0, n, 97)), *by), ignore_index=True)
        pd.testing.assert_frame_equal(got, df.sort_values(by, kind="stable", ignore_index=True))
    assert list(state.in_order([], "at")) == []


def test_checks_of_one_time_are_taken_by_their_id(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i // 8), "a", 30.0 if i % 8 < 4 else 10.0) for i in range(40)]
    (folder := tmp_path / "in").mkdir()
    pd.DataFrame(rows[::-1], columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    assert [tuple(r) for r in health_checked(spark, str(folder)).collect()] == c.sql(SQL["health_checked"]).fetchall()
