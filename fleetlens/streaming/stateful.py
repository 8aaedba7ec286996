"""Keyed-state monitors for streams: alert throttle and free-space state.

Files may arrive out of order, so rows wait in the state until the watermark has
passed them and are then folded in event time.  Rows that come later than the
watermark are dropped.  Equal instants collapse at once, so the state of a key
holds at most the distinct instants of one watermark span.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.operators.alerts import ALERT, DRIVE, alert_throttle
from fleetlens.streaming.runs import waiting_state

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_THROTTLE_STATE = "last bigint, times array<bigint>, ids array<bigint>, delay bigint"


def _watermark_us(state: GroupState) -> int:
    return max(state.getCurrentWatermarkMs(), 0) * 1000


def _park(state: GroupState, waiting: list[int]) -> None:
    """Wake the key when the watermark passes the first waiting row."""
    if waiting:
        state.setTimeoutTimestamp(max(min(waiting) // 1000, state.getCurrentWatermarkMs() + 1))


def _throttle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, times, ids, delay = state.get if state.exists else (None, [], [], 0)
    waiting = dict(zip(times, ids))
    passed = _watermark_us(state)
    if not state.hasTimedOut:
        for pdf in batches:
            for at, event_id, wait in zip(pdf["_at"], pdf["event_id"], pdf["_delay_us"]):
                delay = int(wait)
                if at > passed or passed == 0:
                    waiting[int(at)] = min(int(event_id), waiting.get(int(at), int(event_id)))
    fired = []
    for at in sorted(t for t in waiting if t <= passed):
        event_id = waiting.pop(at)
        if last is None or at >= last + delay:
            last = at
            fired.append((*key, event_id, at))
    state.update((last, list(waiting), list(waiting.values()), delay))
    _park(state, list(waiting))
    yield pd.DataFrame(fired, columns=[*ALERT, "event_id", "_at"])


def alert_throttle_stream(alerts: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """Responses of a stream of matched alerts, as the batch throttle gives them.

    Alerts with delay 0 pass through without state and belong in a query of their
    own, see ``undelayed``.
    """
    held = (
        alerts.where("delay_seconds > 0")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .withColumn("_at", F.unix_micros("ts"))
        .withColumn("_delay_us", F.col("delay_seconds").cast("bigint") * 1_000_000)
    )
    fired = held.groupBy(*ALERT).applyInPandasWithState(
        _throttle,
        "server_name string, alert_name string, event_id bigint, _at bigint",
        _THROTTLE_STATE,
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return fired.select(*ALERT, "event_id", F.timestamp_micros("_at").cast("timestamp_ntz").alias("ts"))


def throttle_tail(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Responses among the alerts that still wait behind the watermark after a run.

    With what the sink holds they are the responses to every row read so far.  The state
    stays as it is, and a later run emits these rows itself unless earlier rows still come.
    """
    kept = waiting_state(spark, checkpoint, f"server_name string, alert_name string, {_THROTTLE_STATE}")
    # the last response suppresses as an alert of its own, without an id
    pairs = F.arrays_zip(F.col("times").alias("_at"), F.col("ids").alias("event_id"))
    last = F.array(F.struct(F.col("last").alias("_at"), F.lit(None).cast("bigint").alias("event_id")))
    rows = kept.where(F.size("times") > 0).select(
        *ALERT, (F.col("delay") / 1_000_000).cast("bigint").alias("delay_seconds"),
        F.explode(F.when(F.col("last").isNull(), pairs).otherwise(F.concat(pairs, last))).alias("row"),
    )
    alerts = rows.select(
        *ALERT, "delay_seconds", "row.event_id", F.timestamp_micros("row._at").cast("timestamp_ntz").alias("ts")
    )
    return alert_throttle(alerts).where("event_id IS NOT NULL")


def undelayed(alerts: DataFrame) -> DataFrame:
    """Alerts that always respond."""
    return alerts.where("delay_seconds = 0").select(*ALERT, "event_id", "ts")


def _free_space(repeat_us: int):
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        amount, alerted, times, amounts = state.get if state.exists else (-1, None, [], [])
        waiting = dict(zip(times, amounts))
        passed = _watermark_us(state)
        if not state.hasTimedOut:
            for pdf in batches:
                for at, free in zip(pdf["_at"], pdf["mb_free"]):
                    if at > passed or passed == 0:
                        waiting[int(at)] = int(free)
        rows = []
        for at in sorted(t for t in waiting if t <= passed):
            free = waiting.pop(at)
            updated = free != amount or alerted is None or alerted < at - repeat_us
            if updated:
                amount, alerted = free, at
            rows.append((*key, at, free, updated))
        state.update((amount, alerted, list(waiting), list(waiting.values())))
        _park(state, list(waiting))
        yield pd.DataFrame(rows, columns=[*DRIVE, "_at", "mb_free", "updated"])

    return fold


def free_space_updates_stream(
    samples: DataFrame, *, threshold_mb: int = 1024, repeat_minutes: int = 15, lateness: str = "10 minutes"
) -> DataFrame:
    """Low samples of a stream with their state flag, as the batch form gives them.

    The severity is per check: aggregate the sink with ``free_space_messages``.
    """
    low = (
        samples.where(F.col("mb_free") < threshold_mb)
        .withColumn("sample_time", F.col("sample_time").cast("timestamp"))
        .withWatermark("sample_time", lateness)
        .withColumn("_at", F.unix_micros("sample_time"))
    )
    rows = low.groupBy(*DRIVE).applyInPandasWithState(
        _free_space(repeat_minutes * 60_000_000),
        "server_name string, drive string, _at bigint, mb_free int, updated boolean",
        "amount bigint, alerted bigint, times array<bigint>, amounts array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return rows.select(
        *DRIVE, F.timestamp_micros("_at").cast("timestamp_ntz").alias("sample_time"), "mb_free", "updated"
    )


def occurrence_counter_stream(alerts: DataFrame, *, lateness: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Occurrences and last occurrence per alert and day, final once the day is over."""
    return (
        alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
        .groupBy(*ALERT, F.window("ts", span).alias("w"))
        .agg(F.count("*").alias("occurrence_count"), F.max("ts").cast("timestamp_ntz").alias("last_occurrence"))
        .select(*ALERT, F.col("w.start").cast("timestamp_ntz").alias("day"), "occurrence_count", "last_occurrence")
    )
