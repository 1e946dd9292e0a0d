import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Context, Name, Policy, table_of
from larkspur.errors import ApiError
from larkspur.streaming import changes, state

OLD = [(1, "a", 1), (2, "b", None), (3, "c", 3)]
NEW = [(1, "a", 1), (2, "b", 5), (4, "d", 4)]
COLS = "id int, name string, value int"


def captured(spark):
    return changes.capture(spark.createDataFrame(OLD, COLS), spark.createDataFrame(NEW, COLS), ["id"], "items")


def test_capture(spark):
    got = {r.operation: (r.old, r.new) for r in captured(spark).collect()}
    assert got == {"UPDATE": ('{"id":2,"name":"b","value":null}', '{"id":2,"name":"b","value":5}'), "DELETE": ('{"id":3,"name":"c","value":3}', None), "INSERT": (None, '{"id":4,"name":"d","value":4}')}
    assert changes.channel_name("items") == "larkspur_public_items"


def test_subscription_and_policy(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    items = spark.createDataFrame(OLD, COLS)
    t = table_of(items, "items", ("id",))
    cat = Catalog({t.name: t}, policies=(Policy(Name("public", "items"), ("anon",), "select", lambda c: F.col("value") < 5),))
    changes.log(captured(spark), folder)
    changes.log(captured(spark).withColumn("channel", F.lit("other")), folder)
    got = changes.drain(changes.table_stream(spark, cat, t, folder), f"file://{tmp_path}/out")
    assert sorted((r.operation, r.id) for r in got.collect()) == [("DELETE", 3), ("INSERT", 4)]
    got = changes.drain(changes.table_stream(spark, Catalog({t.name: t}), t, folder, F.col("value") > 3, Context()), f"file://{tmp_path}/out2")
    assert sorted(r.id for r in got.collect()) == [2, 4]
    assert changes.subscription_fields(cat) == {"items": t.name}
    view = table_of(items, "items_view", is_view=True)
    with pytest.raises(ApiError):
        changes.table_stream(spark, cat, view, folder)


def test_config_and_conditional_notices(spark):
    got = changes.config_changes(captured(spark), "value").collect()
    assert sorted(r.payload for r in got)[0] == '{"table":"items","operation":"DELETE","value":"3"}' and got[0].channel == "larkspur_config_change"
    some = changes.notify_where(captured(spark), spark.createDataFrame(OLD, COLS).schema, F.col("value") > 3)
    assert sorted(r.operation for r in some.collect()) == ["INSERT", "UPDATE"] and some.columns == captured(spark).columns


def test_broker_drops_channels(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    changes.log(captured(spark), folder)
    b = changes.Broker(spark, folder)
    b.start(["larkspur_public_items", "other"])
    q = b.subscribe("larkspur_public_items", lambda d, i: None)
    b.drop("larkspur_public_items")
    assert not q.isActive and b.queries == []
    with pytest.raises(ApiError):
        b.subscribe("larkspur_public_items", lambda d, i: None)
    b.stop()


def test_rate_limit_stream(spark, tmp_path):
    """One batch of requests through the token buckets, time-outs set."""
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(seconds=s)) for k in ("a", "b") for s in (0, 0, 0, 1, 5)]
    spark.createDataFrame(rows, "k string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at timestamp").parquet(f"{tmp_path}/in")
    got = changes.drain(state.rate_limit(stream, "k", "at", 2, 1.0), f"file://{tmp_path}", one_batch=True).orderBy("k", "at").collect()
    assert [sum(r.allowed for r in got if r.k == k) for k in ("a", "b")] == [4, 4]


def test_broker(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    changes.log(captured(spark), folder)
    b = changes.Broker(spark, folder)
    with pytest.raises(ApiError):
        b.subscribe("larkspur_public_items", lambda d, i: None)
    b.start(["larkspur_public_items"])
    with pytest.raises(ApiError):
        b.start([])
    with pytest.raises(ApiError):
        b.subscribe("unheard", lambda d, i: None)
    one, two = [], []
    for seen in (one, two):
        b.subscribe("larkspur_public_items", lambda d, i, seen=seen: seen.extend(r.operation for r in d.collect()), once=True)
    b.subscribe_or_create("late", lambda d, i: None, once=True)
    for q in b.queries:
        q.awaitTermination(120)
    assert sorted(one) == sorted(two) == ["DELETE", "INSERT", "UPDATE"]
    b.stop()
    assert not b.running


def test_steps():
    assert state.debounce_times([0.0, 0.05, 0.1, 0.15, 0.25], None, 0.1) == ([0, 2, 4], 0.25)
    assert state.debounce_times([0.3], 0.25, 0.1) == ([], 0.25)
    ok, tokens, at = state.take_tokens(1.0, 0.0, 0.0, 1, 2, 1)
    assert ok and tokens == 0
    assert state.take_tokens(0.0, 0.0, 0.5, 1, 2, 1) == (False, 0.5, 0.5)
    assert state.take_tokens(0.0, 0.0, 100.0, 2, 2, 1) == (True, 0.0, 100.0)
    up, good, bad = True, 0, 0
    seen = []
    for ok in (False, False, True, False, False, False, True, True):
        up, good, bad = state.health(up, good, bad, ok, 2, 3)
        seen.append(up)
    assert seen == [True, True, True, True, True, False, False, True]


def test_stateful_streams(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("a", at(0), True), ("a", at(40), False), ("a", at(120), False), ("b", at(10), True)]
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, "table string, at timestamp, ok boolean").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("table string, at timestamp, ok boolean").parquet(src)
    told = changes.drain(state.debounce(stream), f"file://{tmp_path}/d").collect()
    assert sorted((r.table, r.at) for r in told) == [("a", at(0)), ("a", at(120)), ("b", at(10))]
    health = changes.drain(state.health_states(stream, "table", "at", "ok", 2, 2), f"file://{tmp_path}/h").collect()
    assert sorted((r.table, r.at, r.healthy) for r in health) == [("a", at(0), True), ("a", at(40), True), ("a", at(120), False), ("b", at(10), True)]
