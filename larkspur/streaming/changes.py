"""Change capture, channels, subscriptions.

A change is (channel, operation, table, schema, old, new) with rows as JSON text: what a
trigger would have notified. `capture` makes changes of two versions of a table; `log` appends
them to a folder; `subscribe` reads the folder as a stream, so a subscriber that falls behind
loses nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspur.catalog import Catalog, Context, Name, TableDef
from larkspur.errors import ApiError
from larkspur.functions.names import camel
from larkspur.operators.security import policy

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("channel", "operation", "table", "schema", "old", "new")] + [T.StructField("at", T.TimestampType())])
PREFIX, FILES_PER_TRIGGER = "larkspur", 256


def channel_name(table: str, schema: str = "public", prefix: str = PREFIX) -> str:
    return f"{prefix}_{schema}_{table}"


def capture(old: DataFrame, new: DataFrame, keys: Iterable[str], table: str, schema: str = "public", prefix: str = PREFIX) -> DataFrame:
    """INSERT has new, DELETE has old, UPDATE has both; rows that are the same in both versions make no change. Keys compare null-safe."""
    keys = list(keys)
    text = lambda a: F.to_json(F.struct(*[F.col(f"{a}.`{c}`") for c in old.columns]), {"ignoreNullFields": "false"})
    o, n = old.withColumn("_o", F.lit(1)).alias("o"), new.select(*old.columns).withColumn("_n", F.lit(1)).alias("n")
    on = None
    for k in keys:
        eq = F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        on = eq if on is None else on & eq
    rows = o.join(n, on, "full")
    gone, come = F.col("_n").isNull(), F.col("_o").isNull()
    same = F.lit(True)
    for c in old.columns:
        same = same & F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
    rows = rows.where(gone | come | ~same)
    return rows.select(
        F.lit(channel_name(table, schema, prefix)).alias("channel"),
        F.when(come, "INSERT").when(gone, "DELETE").otherwise("UPDATE").alias("operation"),
        F.lit(table).alias("table"),
        F.lit(schema).alias("schema"),
        F.when(~come, text("o")).alias("old"),
        F.when(~gone, text("n")).alias("new"),
        F.current_timestamp().alias("at"),
    )


def config_changes(changes: DataFrame, tenant: str = "tenant_id", channel: str = f"{PREFIX}_config_change") -> DataFrame:
    """(channel, payload): of each change of a configuration table, which table, which operation, whose configuration."""
    whose = F.coalesce(F.get_json_object("new", f"$.{tenant}"), F.get_json_object("old", f"$.{tenant}"))
    return changes.select(F.lit(channel).alias("channel"), F.to_json(F.struct("table", "operation", whose.alias(tenant)), {"ignoreNullFields": "false"}).alias("payload"))


def notify_where(changes: DataFrame, row: T.StructType, condition: Column) -> DataFrame:
    """Those of the changes whose row (new, or old when deleted) meets the condition; the others are captured by nobody."""
    text = F.when(F.col("operation") == "DELETE", F.col("old")).otherwise(F.col("new"))
    held = changes.withColumn("_row", F.from_json(text, row)).select("*", "_row.*").where(condition)
    return held.select(*changes.columns)


def log(changes: DataFrame, folder: str) -> None:
    """Appends changes to the log."""
    changes.select(*SCHEMA.names).write.mode("append").partitionBy().parquet(folder)


def source(spark: SparkSession, folder: str, per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def decode(changes: DataFrame, row: T.StructType) -> DataFrame:
    """The row of each change: new, or old when deleted. Payloads that don't parse are skipped."""
    text = F.when(F.col("operation") == "DELETE", F.col("old")).otherwise(F.col("new"))
    parsed = changes.withColumn("row", F.from_json(text, row, {"mode": "PERMISSIVE"})).where(F.col("row").isNotNull() & text.isNotNull())
    return parsed.select("operation", "at", "row.*")


def table_stream(spark: SparkSession, catalog: Catalog, table: TableDef, folder: str, where: Column | None = None, ctx: Context | None = None, prefix: str = PREFIX) -> DataFrame:
    """The changed rows of one base table under a filter and the role's policy."""
    if table.is_view:
        raise ApiError("bad_request", "not_subscribable", f"{table.name.name} is a view")
    schema = T.StructType([T.StructField(c.name, c.type) for c in table.columns])
    df = decode(source(spark, folder).where(F.col("channel") == channel_name(table.name.name, table.name.schema, prefix)), schema)
    rule = policy(catalog, table.name, ctx or Context(), "select")
    for c in (rule, where):
        if c is not None:
            df = df.where(c)
    return df


def subscription_fields(catalog: Catalog) -> dict[str, Name]:
    """One subscription a base table."""
    return {camel(t.name.name): t.name for t in catalog.tables.values() if not t.is_view}


@dataclass
class Broker:
    """Starts and stops one streaming query a subscriber; a channel must have been opened first."""

    spark: SparkSession
    folder: str
    interval: str = "1 second"
    running: bool = False
    channels: set[str] = field(default_factory=set)
    queries: list[StreamingQuery] = field(default_factory=list)
    named: dict[str, str] = field(default_factory=dict)

    def start(self, channels: Iterable[str]) -> None:
        if self.running:
            raise ApiError("conflict", "already_running", "the broker is running")
        self.channels, self.running = set(channels), True

    def listen(self, channel: str) -> None:
        self.channels.add(channel)

    def drop(self, channel: str) -> None:
        """Ends a channel's capture: its subscribers stop, and new ones are refused until it is opened again."""
        self.channels.discard(channel)
        for q in [q for q in self.queries if self.named.get(q.id) == channel]:
            q.stop()
            self.queries.remove(q)

    def subscribe(self, channel: str, handle: Callable[[DataFrame, int], None], where: Column | None = None, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
        """handle(batch, id) gets each batch of the channel's changes."""
        if not self.running or channel not in self.channels:
            raise ApiError("not_found", "unknown_channel", f"nobody listens on {channel}")
        df = source(self.spark, self.folder).where(F.col("channel") == channel)
        if where is not None:
            df = df.where(where)
        writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint or f"{self.folder}-checkpoints/{uuid.uuid4().hex}")
        q = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)).start()
        self.queries.append(q)
        self.named[q.id] = channel
        return q

    def subscribe_or_create(self, channel: str, handle: Callable[[DataFrame, int], None], **kw) -> StreamingQuery:
        self.listen(channel)
        return self.subscribe(channel, handle, **kw)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries, self.running = [], False


def drain(stream: DataFrame, folder: str, timeout: float = 600, one_batch: bool = False) -> DataFrame:
    """All that a stream has now, as a table: written by one query until the source is read out. one_batch: in a single batch, for states with time-outs, which else wait for them without end."""
    base = f"{folder.rstrip('/')}/drain-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(**({"once": True} if one_batch else {"availableNow": True})).start()
    end = time.time() + timeout
    while q.isActive and time.time() < end:
        q.awaitTermination(1)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"the stream had more than {timeout} s of rows")
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
