"""Restores that are judged again with every new state of their database, until they end.

A restore that leaves a usable database is followed in the snapshots of the database states
that come after it.  ONLINE ends it; an unusable state ends it with an alert; RESTORING and
RECOVERING, and any other state, mean to wait for the next snapshot.  After ``timeout`` it ends
in any case: without any snapshot of the database as dropped, else as unfinished.

``restore_outcomes`` works on tables: one look forward to the first state that decides and
one look back from the end of the wait.  ``restore_outcomes_stream`` keeps the open restores
and the snapshots of the watermark span in keyed state, with a timer at the next instant at
which something can end; its rows are those of the batch form.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.functions.ordered import asof_latest
from fleetlens.streaming.runs import waiting_state

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DATABASE = ["server_name", "database_name"]
# fixed values: states that end the wait, and the reasons of the alerts
UNUSABLE = ("OFFLINE", "RECOVERY PENDING", "SUSPECT", "EMERGENCY")
NOT_ONLINE = "Restored database is not ONLINE:"
UNKNOWN = "Database state is unknown:"
GONE = "Restored database no longer exists:"
UNFINISHED = "Restore has not ended in time:"

OUTCOME = "server_name string, database_name string, event_id bigint, post_time timestamp_ntz, outcome string, ended_at timestamp_ntz, reason string"


def followed_restores(events: DataFrame) -> DataFrame:
    """Restores of whole databases that should leave them usable: key, event_id and post_time.

    Events without a server, database or time cannot be followed and are left out.
    """
    return events.where(
        ~F.col("corrupt") & (F.col("event_type") == "AUDIT_BACKUP_RESTORE_EVENT") & (F.col("event_subclass") == 2)
        & F.col("command_text").ilike("%RESTORE%DATABASE%") & ~F.col("command_text").ilike("%NORECOVERY%")
    ).select(*DATABASE, "event_id", "post_time").dropna()


def judged(state: Column) -> Column:
    """What a state makes of a restore; null means to wait."""
    name = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    return F.when(name == "ONLINE", "online").when(name.isin(*UNUSABLE), "not online").when(name == "", "unknown")


def _reasons(outcome: Column) -> Column:
    reasons = {"not online": NOT_ONLINE, "unknown": UNKNOWN, "gone": GONE, "unfinished": UNFINISHED}
    out = F.lit(None).cast("string")
    for name, reason in reasons.items():
        out = F.when(outcome == name, reason).otherwise(out)
    return out


def _worst(states: DataFrame) -> DataFrame:
    """One verdict a database and instant: of several rows the one that is worst for a restore.

    Order: an unusable state, an unknown one, online, waiting.
    """
    verdict = judged(F.col("state_desc"))
    rank = F.when(verdict == "not online", 3).when(verdict == "unknown", 2).when(verdict == "online", 1).otherwise(0)
    rows = states.dropna(subset=[*DATABASE, "snapshot_time"]).withColumn("_rank", rank)
    return rows.groupBy(*DATABASE, "snapshot_time").agg(F.max("_rank").alias("rank"))


_OF_RANK = {3: "not online", 2: "unknown", 1: "online"}


def _outcome(rank: Column) -> Column:
    return F.when(rank == 3, "not online").when(rank == 2, "unknown").when(rank == 1, "online")


def restore_outcomes(restores: DataFrame, states: DataFrame, *, timeout: str = "6 hours") -> DataFrame:
    """How each followed restore ended: outcome, time and reason (null for online).

    ``states`` has server_name, database_name, snapshot_time and state_desc.  Nothing is paired:
    both looks are as-of lookups over the union of restores and snapshots.
    """
    # the earliest deciding snapshot at or after a restore is the latest before it in mirrored time
    mirrored = lambda c: F.timestamp_micros(-F.unix_micros(F.col(c).cast("timestamp"))).cast("timestamp_ntz")
    snapshots = _worst(states)
    asked = restores.withColumns({"_mirror": mirrored("post_time"), "_end": F.col("post_time") + F.expr(f"INTERVAL {timeout}")})
    deciding = snapshots.where("rank > 0").withColumn("_mirror", mirrored("snapshot_time"))
    first = asof_latest(deciding, asked, DATABASE, "_mirror", "_mirror", ["snapshot_time", "rank"], block="DAY")
    first = first.withColumnRenamed("asof", "_first")
    last = asof_latest(snapshots, first, DATABASE, "snapshot_time", "_end", ["snapshot_time"], block="DAY")
    decided = F.coalesce(F.col("_first.snapshot_time") <= F.col("_end"), F.lit(False))
    seen = F.coalesce(F.col("asof.snapshot_time") >= F.col("post_time"), F.lit(False))
    outcome = F.when(decided, _outcome(F.col("_first.rank"))).when(seen, "unfinished").otherwise("gone")
    rows = last.withColumn("outcome", outcome)
    return rows.select(
        *DATABASE, "event_id", "post_time", "outcome",
        F.when(decided, F.col("_first.snapshot_time")).otherwise(F.col("_end")).alias("ended_at"), _reasons(F.col("outcome")).alias("reason"),
    )


def _follow(timeout_us: int):
    """State function: open restores and the snapshots that are not yet behind all of them."""

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, posted, times, ranks = state.get if state.exists else ([], [], [], [])
        open_, seen = dict(zip(ids, posted)), dict(zip(times, ranks))
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        if not state.hasTimedOut:
            for pdf in batches:
                events = pdf[pdf["rank"] < 0]
                open_.update(zip(events["event_id"].tolist(), events["_at"].tolist()))
                worst = pdf[pdf["rank"] >= 0].groupby("_at")["rank"].max()
                for at, rank in zip(worst.index.tolist(), worst.tolist()):
                    seen[at] = max(rank, seen.get(at, 0))
        order = sorted(at for at in seen if at <= passed)  # what the watermark has passed is complete
        deciding = [at for at in order if seen[at]]
        ended = []
        for event_id, at in sorted(open_.items(), key=lambda x: (x[1], x[0])):
            if at > passed:
                break
            end = at + timeout_us
            place = next((s for s in deciding if s >= at), None)
            if place is not None and place <= end:
                ended.append((*key, event_id, at, _OF_RANK[seen[place]], place))
            elif end <= passed:
                any_ = any(at <= s <= end for s in order)
                ended.append((*key, event_id, at, "unfinished" if any_ else "gone", end))
        for row in ended:
            del open_[row[2]]
        # a snapshot before the oldest open restore and the watermark judges nothing any more
        needed = min([*open_.values(), passed + 1])
        seen = {at: rank for at, rank in seen.items() if at >= needed}
        if open_ or seen:
            state.update((list(open_), list(open_.values()), list(seen), list(seen.values())))
            # a snapshot to judge with, or the end of a wait, whichever the watermark passes first
            wakes = [at + timeout_us for at in open_.values()] + [at for at in seen if at > passed]
            if wakes:
                state.setTimeoutTimestamp(max(min(wakes) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ended, columns=[*DATABASE, "event_id", "_at", "outcome", "_ended"])

    return follow


_OPEN = "ids array<bigint>, posted array<bigint>, times array<bigint>, ranks array<int>"


def restore_outcomes_stream(restores: DataFrame, states: DataFrame, *, timeout_seconds: int = 6 * 3600, lateness: str = "10 minutes") -> DataFrame:
    """The outcomes of a stream of restores and a stream of snapshots, each once.

    Rows are emitted when the watermark, which follows the slower of the two streams, has
    passed what decides them.  Restores still open at the end of a run stay in the state.
    """
    def clock(df: DataFrame, column: str, rank: Column, event_id: Column) -> DataFrame:
        timed = df.dropna(subset=[*DATABASE, column]).select(*DATABASE, F.col(column).cast("timestamp").alias("ts"), rank.alias("rank"), event_id.alias("event_id"))
        return timed.withWatermark("ts", lateness)

    verdict = judged(F.col("state_desc"))
    rank = F.when(verdict == "not online", 3).when(verdict == "unknown", 2).when(verdict == "online", 1).otherwise(0)
    both = clock(restores, "post_time", F.lit(-1), F.col("event_id").cast("bigint")).unionByName(
        clock(states, "snapshot_time", rank, F.lit(-1).cast("bigint"))
    ).withColumn("_at", F.unix_micros("ts"))
    ended = both.groupBy(*DATABASE).applyInPandasWithState(
        _follow(timeout_seconds * 1_000_000),
        "server_name string, database_name string, event_id bigint, _at bigint, outcome string, _ended bigint",
        _OPEN, "append", GroupStateTimeout.EventTimeTimeout,
    )
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return ended.select(
        *DATABASE, "event_id", at("_at").alias("post_time"), "outcome", at("_ended").alias("ended_at"), _reasons(F.col("outcome")).alias("reason")
    )


def open_outcomes(spark: SparkSession, checkpoint: str, *, timeout: str) -> DataFrame:
    """Outcomes, by the snapshots read so far, of the restores that are open after a run.

    The state stays as it is; a later run ends these restores itself, with the snapshots still to come.
    """
    kept = waiting_state(spark, checkpoint, f"server_name string, database_name string, {_OPEN}")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    restores = kept.select(*DATABASE, F.explode(F.arrays_zip("ids", "posted")).alias("row")).select(
        *DATABASE, F.col("row.ids").alias("event_id"), at("row.posted").alias("post_time")
    )
    words = F.element_at(F.array(F.lit("RESTORING"), F.lit("ONLINE"), F.lit(""), F.lit("OFFLINE")), F.col("row.ranks") + 1)
    states = kept.select(*DATABASE, F.explode(F.arrays_zip("times", "ranks")).alias("row")).select(
        *DATABASE, at("row.times").alias("snapshot_time"), words.alias("state_desc")
    )
    return restore_outcomes(restores, states, timeout=timeout)


def outcome_alerts(outcomes: DataFrame) -> DataFrame:
    """The outcomes that call for an alert."""
    return outcomes.where("reason IS NOT NULL")
