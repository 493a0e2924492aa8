"""Continuous forms: micro-batch upserts, change windows, sessions, rate limits, and change tracking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.incremental import upsert_sources


def change_windows(events: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """(key, start, n, paths) of change events (key, path, ts): counts by tumbling windows. Works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", f"{seconds} seconds")
    return rows.groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("path").alias("paths")).select("key", F.col("w.start").alias("start"), "n", "paths")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions with gaps below ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_stream(changes: DataFrame, table_path: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], trigger: dict | None = None):
    """Keep a passage table up to date: each micro-batch's files replace the passages of their sources.

    The table has a folder for each version; the newest is named by the query's batch, so a batch that is run again
    writes the same folder. Readers take the largest version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = extract(batch)
        gone = new.select("source").distinct()
        old = spark.read.parquet(f"{table_path}/v={number - 1}") if number else new.limit(0)
        upsert_sources(old, new, gone).write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rate_limited(requests: DataFrame, rate: float, burst: float, idle_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """(key, ts, allowed) of requests (key, ts): a token bucket for each key, forgotten after ten idle minutes of event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        for f in frames:
            f = f.sort_values("ts")
            allowed = []
            for ts in f.ts:
                at = ts.timestamp()
                tokens = min(burst, tokens + rate * max(0.0, at - last)) if last is not None else burst
                last = at if last is None else max(last, at)
                allowed.append(tokens >= 1)
                tokens -= 1 if tokens >= 1 else 0
            yield pd.DataFrame({"key": key[0], "ts": f.ts, "allowed": allowed})
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + idle_ms)

    rows = requests.select(F.col("key").cast("string").alias("key"), "ts").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_batch(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """The same over a table: (key, ts, allowed)."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        tokens, last, allowed = burst, None, []
        for ts in f.ts:
            at = ts.timestamp()
            tokens = burst if last is None else min(burst, tokens + rate * max(0.0, at - last))
            last = at
            allowed.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        return f.assign(allowed=allowed)

    return requests.select(F.col("key").cast("string").alias("key"), "ts").groupBy("key").applyInPandas(step, "key string, ts timestamp, allowed boolean")


def tracked(changes: DataFrame) -> DataFrame:
    """The newest (path, hash, ts) of a change log; a stream in update mode, or a table."""
    return changes.groupBy("path").agg(F.max_by("hash", "ts").alias("hash"), F.max("ts").alias("ts"))


#: The states of a task and where they may lead.
TASK_STATES = {"QUEUED": {"RUNNING", "CANCELLED"}, "RUNNING": {"COMPLETED", "FAILED", "CANCELLED"}}


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Rows of (task, seq, status) whose step from the one before isn't allowed; the first must be QUEUED."""
    from pyspark.sql.window import Window

    before = F.lag("status").over(Window.partitionBy("task").orderBy("seq"))
    good = F.col("before").isNull() & (F.col("status") == "QUEUED")
    for a, to in TASK_STATES.items():
        good = good | ((F.col("before") == a) & F.col("status").isin(*sorted(to)))
    return log.withColumn("before", before).where(~F.coalesce(good, F.lit(False)))


def since(conversations: DataFrame, mark, newest: int = 5) -> DataFrame:
    """Conversations updated after a high-water mark, the newest first."""
    return conversations.where(F.col("updated_at") > mark).orderBy(F.desc("updated_at")).limit(newest)


def published(events: DataFrame, path: str, checkpoint: str | None = None):
    """Append events (topic, payload as a struct or map) to a folder of topics, as JSON; a stream needs a checkpoint."""
    rows = events.select("topic", F.to_json("payload").alias("payload"))
    if events.isStreaming:
        return rows.writeStream.format("parquet").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return rows.write.mode("append").partitionBy("topic").parquet(path)


def subscribed(spark, path: str, topic: str) -> DataFrame:
    """The stream of a topic's events, the payload decoded to a map."""
    rows = spark.readStream.schema("topic string, payload string").parquet(path).where(F.col("topic") == topic)
    return rows.select("topic", F.from_json("payload", "map<string,string>").alias("payload"))


def watched(spark, path: str) -> DataFrame:
    """(path, hash, ts) of files as they appear or change below a folder; removals come from ``incremental.changed`` over a scan."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("ts"))


def pending(changes: DataFrame, seconds: int = 5, late: str = "1 minute") -> DataFrame:
    """(index, start, files): files of each index that changed in a window, each once; a table or a stream."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    w = F.window("ts", f"{seconds} seconds").alias("w")
    return rows.groupBy("index", w).agg(F.size(F.collect_set("path")).cast("long").alias("files")).select("index", F.col("w.start").alias("start"), "files")
