"""Structured Streaming twins of the window queries, an upsert sink and a stateful spell operator."""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream; the time as an instant, so that watermarks hold."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n_events", "total")


def sliding(events: DataFrame, late: str = "1 hour", width: str = "7 days", step: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n_events"), F.approx_count_distinct("user_id").alias("n_users")).select(F.col("window.start").alias("start"), "n_events", "n_users")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), "n_events")


def enrich(events: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(users, key, "left")


def paired(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Two streams of events: each event of the left with those of its user on the right at most so long before it.

    Watermarks on both sides and the bound of time let Spark drop state that can't match any more; with how='leftOuter' an
    event without a match comes once the watermark has passed its bound.
    """
    a = left.withWatermark("ts", late).select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("__user"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    near = (F.col("right_ts") <= F.col("left_ts")) & (F.col("right_ts") >= F.col("left_ts") - F.expr(f"interval {within}"))
    return a.join(b, (F.col("user_id") == F.col("__user")) & near, how).drop("__user")


def upsert_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key in versions under a folder.

    Each batch writes a new version from the last complete one, so a repeated batch gives the same version again.
    """
    from tidemark.operators.relational import top_per_key

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.parquet(f"{path}/version={number - 1}").unionByName(batch)
        top_per_key(rows, keys, [F.desc(c) for c in order]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


SPELLS = "user_id long, event_type string, n_events long, first_id long, last_id long"


def spells(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed runs of equal event types of a user, emitted when the type changes; the open run is the state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, n, first, last = state.get if state.exists else (None, 0, 0, 0)
        closed = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event_id, event_type in zip(rows.event_id, rows.event_type, strict=True):
            if event_type != kind:
                if n:
                    closed.append((key[0], kind, n, first, last))
                kind, n, first = event_type, 0, int(event_id)
            n, last = n + 1, int(event_id)
        state.update((kind, n, first, last))
        yield pd.DataFrame(closed, columns=["user_id", "event_type", "n_events", "first_id", "last_id"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, SPELLS, "kind string, n long, first long, last long", "append", GroupStateTimeout.NoTimeout)


def ordered_spells(events: DataFrame, late: str = "1 hour", idle_seconds: int = 1800) -> DataFrame:
    """Runs of equal event types of a user in the order of event time; a pause of more than idle_seconds ends a run too.

    Events are held back until the watermark has passed them, so what comes out of order within `late` is put in order, and what is later still is
    dropped. A timer ends the last run when the watermark is idle_seconds past it, and a user without an open run or held events
    leaves no state. The result doesn't depend on how events arrive.
    """
    idle = idle_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        kind, n, first, last, at, held = state.get if state.exists else (None, 0, 0, 0, 0, "[]")
        waiting = [tuple(x) for x in json.loads(held)]
        if not state.hasTimedOut:
            for rows in frames:
                waiting += zip(rows.ts.astype("datetime64[us]").astype("int64").tolist(), rows.event_id.tolist(), rows.event_type.tolist(), strict=True)
        waiting.sort(key=lambda x: (x[0], x[1]))
        ready = bisect.bisect_right(waiting, mark, key=lambda x: x[0])
        closed = []
        for ts, event_id, event_type in waiting[:ready]:
            if n and (event_type != kind or ts - at > idle):
                closed.append((key[0], kind, n, first, last))
                n = 0
            if not n:
                kind, first = event_type, event_id
            n, last, at = n + 1, event_id, ts
        waiting = waiting[ready:]
        if n and mark - at > idle and not (waiting and waiting[0][0] - at <= idle):
            closed.append((key[0], kind, n, first, last))
            n = 0
        if n or waiting:
            state.update((kind, n, first, last, at, json.dumps(waiting)))
            due = min([at + idle] * bool(n) + [w[0] for w in waiting[:1]])
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=["user_id", "event_type", "n_events", "first_id", "last_id"])

    kinds = "kind string, n long, first long, last long, at long, held string"
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, SPELLS, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The whole output of a stream over what is there now, as a table in memory. For tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
