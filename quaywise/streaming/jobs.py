"""Structured Streaming jobs: publish, discover and dispatch streams, message dedupe, retries, latency windows.

Sources are file streams here; a Kafka source fits the same functions where its connector is on the class path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaywise.operators import dispatch

MESSAGE = "key string, value string, ts timestamp, seq long"


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE, files_per_trigger: int = 10, kafka: dict[str, str] | None = None) -> DataFrame:
    """Keyed text messages as a stream: Parquet files, or Kafka with the given options."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"), F.col("offset").alias("seq"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_envelopes(messages: DataFrame) -> DataFrame:
    """Request envelopes ``{meta, payload}`` with the flags their meta carries."""
    v = F.try_parse_json("value")
    flag = lambda name: F.try_variant_get(v, f"$.meta.{name}", "boolean").alias(name)
    text = lambda path, name: F.try_variant_get(v, path, "string").alias(name)
    return messages.select(*messages.columns, text("$.meta.subscriberId", "subscriber_id"), text("$.meta.recordId", "record_id"), flag("active"), flag("valid"), text("$.payload.context.messageId", "message_id"), text("$.payload.context.transactionId", "transaction_id"), F.try_variant_get(v, "$.payload", "variant").alias("payload"))


def read_responses(messages: DataFrame) -> DataFrame:
    """Answers that wait for their callback: who gets them (from ``meta``), what their context says, the body to send, and
    ``dead_reason`` where they cannot be sent. An answer without ``payload`` is taken as the body itself."""
    v = F.try_parse_json("value")
    body = F.coalesce(F.try_variant_get(v, "$.payload", "variant"), v)
    text = lambda of, path: F.nullif(F.trim(F.try_variant_get(of, path, "string")), F.lit(""))
    rows = messages.select(
        *messages.columns,
        v.isNotNull().alias("_json"),
        text(v, "$.meta.subscriberId").alias("subscriber_id"),
        text(v, "$.meta.recordId").alias("record_id"),
        text(body, "$.context.action").alias("action"),
        text(body, "$.context.transactionId").alias("transaction_id"),
        text(body, "$.context.messageId").alias("message_id"),
        F.try_variant_get(body, "$.context", "map<string,variant>").isNotNull().alias("_context"),
        F.to_json(body).alias("body"),
    )
    no_one = F.col("subscriber_id").isNull() | F.col("record_id").isNull()
    reason = F.when(~F.col("_json"), "not JSON").when(no_one, "no subscriber or record id").when(~F.col("_context"), "no context")
    return rows.withColumn("dead_reason", reason).drop("_json", "_context")


def dedupe_stream(messages: DataFrame, seconds: int = 60, late: str = "60 seconds") -> DataFrame:
    """Messages (``message_id, ts, ...``) that pass: no equal one was let through within the time to live before. The
    moment of the last one let through is the state of an id; it is dropped once the watermark has passed its time."""
    columns, ttl = messages.columns, pd.Timedelta(seconds=seconds)

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"] if "event_id" in columns else ["ts"])
        keep = []
        for ts in rows["ts"]:
            keep.append(last is None or ts > last + ttl)
            last = ts if keep[-1] else last
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + ttl).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield rows[keep][columns]

    timed = messages.withWatermark("ts", late)
    return timed.groupBy("message_id").applyInPandasWithState(accept, messages.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_batch(messages: DataFrame, seconds: int = 60) -> DataFrame:
    """The batch form, as one pass over the messages in order of id and time: it remembers one moment, whatever the
    number of equal messages."""
    ordered = messages.repartition("message_id").sortWithinPartitions("message_id", "ts", "event_id")
    source = ordered.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    ttl = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0
        for batch in batches:
            keep = []
            for name, at in zip(batch.column("message_id").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                keep.append(name != now or at > last + ttl)
                if keep[-1]:
                    now, last = name, at
            yield batch.filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(run, source.schema).drop("_at")


def message_key(subscriber: str = "subscriber_id", provider: str = "bpp_id"):
    """Ordering key: the subscriber, else the provider, else none."""
    return F.coalesce(F.nullif(F.trim(subscriber), F.lit("")), F.nullif(F.trim(provider), F.lit("")))


def discover_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Requests meet the latest tables (read anew by ``answer`` for every batch); answers are written by batch."""
    return requests.writeStream.foreachBatch(lambda df, n: answer(df).write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def dispatch_stream(envelopes: DataFrame, registry: Callable[[], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Envelopes become delivery tasks or dead letters, by batch."""

    def send(df: DataFrame, n: int) -> None:
        resolved = dispatch.resolve_callbacks(df, registry())
        resolved.where("dead_reason is null").write.mode("overwrite").parquet(f"{out}/tasks/batch={n}")
        resolved.where("dead_reason is not null").write.mode("overwrite").parquet(f"{out}/dead/batch={n}")

    return envelopes.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def lag_windows(timed: DataFrame, value: str = "lag_ms", every: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Count, mean and approximate 99th percentile of a lag by window, with late data allowed for a while."""
    return timed.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.99).alias("p99"))


def burst_recovery(windows: DataFrame, burst_end, budget: float) -> DataFrame:
    """Seconds from the end of a burst to the first window whose p99 is back under budget."""
    after = windows.where((F.col("window.start") >= burst_end) & (F.col("p99") <= budget))
    return after.agg((F.unix_seconds(F.min("window.start").cast("timestamp")) - F.unix_seconds(F.lit(burst_end).cast("timestamp"))).alias("recovery_s"))
