"""Ambient state, debouncing and cooldowns: ordered folds in batch, and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.streaming import scan

# Fixed values.
STALE_SECONDS = 600
STATES = {"session_start": "active_work", "working": "active_work", "idle": "waiting_or_idle", "turn_complete": "turn_complete", "session_end": "quiet"}
NEEDS = {"session_start": "start", "working": "busy", "idle": "idle", "turn_complete": "complete", "session_end": "complete"}
CAPABILITIES = {"manual": (), "claude": ("complete",), "opencode": ("start", "busy", "idle", "complete"), "codex_notify": ("complete",)}


def _lookup(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def state_of(event_type: Column) -> Column:
    return _lookup(STATES, event_type)


def posture(state: Column) -> Column:
    return F.when(state == "active_work", "active").otherwise("quiet")


def normalize(events: DataFrame) -> DataFrame:
    """Events (adapter, event_type, ...) that the adapter's capabilities support."""
    allowed = [(a, e) for a, can in CAPABILITIES.items() for e, need in NEEDS.items() if need in can]
    dim = events.sparkSession.createDataFrame(allowed, "adapter string, event_type string")
    kept = events.join(F.broadcast(dim), ["adapter", "event_type"], "left_semi")
    return kept.withColumn("job_status", F.when(F.col("event_type") == "working", "running").otherwise("succeeded"))


def changes(events: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, at, state): the changes of state per key. A repeat of a state counts only after the state has gone stale, measured from its last change.

    A parallel scan: a session may hold any share of the events.
    """
    known = events.select(key, F.col("ts").alias("at"), state_of(F.col("event_type")).alias("kind")).where("kind IS NOT NULL")
    return scan.counted(known, key, STALE_SECONDS * 1_000_000).withColumnRenamed("kind", "state")


def current(changed: DataFrame, now: Column, key: str = "session_id") -> DataFrame:
    """State and posture per key as read at ``now``."""
    last = changed.groupBy(key).agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))
    fresh = F.unix_micros(now) - F.unix_micros("at") <= STALE_SECONDS * 1_000_000
    return last.select(key, F.when(fresh, F.col("state")).otherwise("unknown").alias("state")).withColumn("posture", posture(F.col("state")))


def debounce(events: DataFrame, key: str = "session_id", seconds: float = 1.0) -> DataFrame:
    """Events without those of the kind emitted last that come less than ``seconds`` after it."""
    known = events.select(key, F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return scan.counted(known, key, int(seconds * 1_000_000) - 1).select(key, F.col("at").alias("ts"), F.col("kind").alias("event_type"))


def changes_stream(events: DataFrame, key: str = "session_id", lateness: str | None = None) -> DataFrame:
    """Streaming twin of ``changes``: keyed state of the last change; within a micro-batch events are ordered by time.

    With ``lateness``, the watermark's delay, a key's state goes once it is stale by event time: what comes after is a change anyway.
    """
    if lateness is not None:
        events = events.withWatermark("ts", lateness)
    known = events.select(key, F.col("ts").alias("at"), state_of(F.col("event_type")).alias("state")).where("state IS NOT NULL")

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "state"])
        out = []
        for at, now in zip(rows["at"], rows["state"], strict=True):
            micros = at.value // 1000
            if last is None or last[1] != now or micros - last[0] > STALE_SECONDS * 1_000_000:
                last = (micros, now)
                out.append((k[0], at, now))
        if last is not None:
            state.update(last)
            if lateness is not None:
                state.setTimeoutTimestamp(max(last[0] // 1000 + STALE_SECONDS * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, "at", "state"])

    kind = events.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout
    return known.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, at timestamp, state string", "at long, state string", "append", timeout)


def cooldown_stream(pulses: DataFrame, exposures: DataFrame, hours: float = 6.0) -> DataFrame:
    """Streaming exposures kept by watermark, one per fingerprint within ``hours``: what a feed must not show again now."""
    return exposures.withWatermark("exposed_at", f"{int(hours * 3600)} seconds").dropDuplicatesWithinWatermark(["fingerprint"]).join(pulses, "fingerprint")


def acknowledged(batch_id_col: str, exposures: DataFrame, path: str):
    """``foreachBatch`` sink that appends exposures not written before: replays of a batch add nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path).select(batch_id_col)
            batch = batch.join(old, batch_id_col, "left_anti")
        except Exception as e:  # the first batch: nothing was written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.dropDuplicates([batch_id_col]).write.mode("append").parquet(path)

    return exposures.writeStream.foreachBatch(write)
