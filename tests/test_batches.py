"""Several outputs of one stream, late rows, and restores that are judged again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.session import stage_path
from fleetlens.streaming import batches, rechecks
from fleetlens.streaming.runs import read_files, run_to_parquet

ROW = "id bigint, ts timestamp_ntz"


@pytest.fixture
def feed(spark, at):
    folder = stage_path(spark, "feed")

    def deliver(*records, schema=ROW):
        values = [tuple(at(f"2024-01-{v}") if isinstance(v, str) and v[:2].isdigit() else v for v in r) for r in records]
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(folder)
        return folder

    return deliver


def test_a_crash_between_two_outputs_leaves_neither(spark, feed):
    path, offsets = stage_path(spark, "together"), stage_path(spark, "together-offsets")
    folder = feed((1, "01 10:00:00"), (2, "01 11:00:00"))
    crash = {"on": False}

    def outputs(batch, high):
        def second():
            if crash["on"]:
                raise RuntimeError("executor room on fire")
            return batch.withColumn("twice", F.col("id") * 2)

        class Lazy(dict):
            def items(self):
                yield "first", batch
                yield "second", second()

        return Lazy()

    def read():
        first = batches.read_output(spark, path, "first", ROW)
        second = batches.read_output(spark, path, "second", f"{ROW}, twice bigint")
        return sorted(r.id for r in first.collect()), sorted(r.twice for r in second.collect())

    run = lambda: batches.run_together(read_files(spark, folder), outputs, path=path, checkpoint=offsets, time="ts")
    assert read() == ([], [])
    run()
    assert read() == ([1, 2], [2, 4])
    feed((3, "01 12:00:00"))
    crash["on"] = True
    with pytest.raises(Exception, match="on fire"):
        run()
    assert read() == ([1, 2], [2, 4])  # the first output of the broken batch is not shown
    crash["on"] = False
    run()
    run()
    assert read() == ([1, 2, 3], [2, 4, 6])
    entries = batches.ledger(spark, path).orderBy("batch").collect()
    assert [(r.outputs, r.rows) for r in entries] == [(["first", "second"], [2, 2]), (["first", "second"], [1, 1])]


def test_a_batch_with_a_ledger_row_is_passed_over(spark, feed):
    """The crash after the ledger row, before Spark's own commit: the batch comes again."""
    path = stage_path(spark, "together")
    folder = feed((1, "01 10:00:00"))
    for _ in range(2):  # new offsets: the same batch number and rows
        batches.run_together(read_files(spark, folder), lambda batch, high: {"one": batch}, path=path)
    assert [r.id for r in batches.read_output(spark, path, "one", ROW).collect()] == [1]
    assert batches.ledger(spark, path).count() == 1


def test_a_batch_is_spread_before_it_is_held(spark, feed):
    folder = feed(*[(i, "01 10:00:00") for i in range(400)])
    seen = []

    def outputs(batch, high):
        seen.append([r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()])
        return {"all": batch}

    path = batches.run_together(read_files(spark, folder), outputs, prepare=lambda b: b.repartition(4).withColumn("twice", F.col("id") * 2))
    assert seen == [[100] * 4]
    assert batches.read_output(spark, path, "all", f"{ROW}, twice bigint").agg(F.sum("twice")).first()[0] == 400 * 399


def test_late_rows_are_kept(spark, feed):
    path, offsets = stage_path(spark, "late"), stage_path(spark, "late-offsets")
    deliveries = [
        [(1, "05 10:00:00"), (2, "01 10:00:00"), (3, None)],  # first batch: nothing is late
        [(4, "05 09:50:00"), (5, "05 09:50:01"), (6, "06 00:00:00"), (7, None)],
        [(8, "05 23:00:00"), (9, "07 00:00:00")],
    ]
    for rows in deliveries:
        batches.route_late(read_files(spark, feed(*rows)), "ts", lateness="10 minutes", path=path, checkpoint=offsets)
    ids = {n: sorted(r.id for r in batches.read_output(spark, path, n, ROW).collect()) for n in ("on_time", "late")}
    assert ids == {"on_time": [1, 2, 3, 5, 6, 7, 9], "late": [4, 8]}


def test_corrections(spark, at):
    alert = "server_name string, alert_name string, ts timestamp_ntz, delay_seconds bigint, event_id bigint"
    given = spark.createDataFrame([("s", "a", at("2024-01-01 10:00:00"), 1), ("s", "b", at("2024-01-01 10:00:00"), 2)],
                                  "server_name string, alert_name string, ts timestamp_ntz, event_id bigint")
    late = [("s", "a", "10:05:00", 10), ("s", "a", "10:10:00", 11), ("s", "a", "10:15:00", 12), ("s", "a", "09:55:00", 13), ("s", "c", "10:00:00", 14)]
    late = spark.createDataFrame([(s, a, at(f"2024-01-01 {t}"), 600, i) for s, a, t, i in late], alert)
    # 13 takes the place of the response at 10:00, so 10 and 12 are no longer suppressed
    assert {r.event_id for r in batches.late_corrections(given, late).collect()} == {10, 12, 13, 14}
    alone = batches.late_corrections(given, late.where("event_id <> 13"))
    assert {r.event_id for r in alone.collect()} == {11, 14}


def states(rows, at):
    return [(s, d, at(f"2024-01-{t}"), state) for s, d, t, state in rows]


RESTORE = "server_name string, database_name string, event_id bigint, post_time timestamp_ntz"
STATE = "server_name string, database_name string, snapshot_time timestamp_ntz, state_desc string"


def test_outcomes(spark, at):
    restores = [("s", d, i, at("2024-01-01 10:00:00")) for i, d in enumerate("abcdefgh")] + [("s", "a", 20, at("2024-01-01 10:30:00"))]
    snaps = states([
        ("s", "a", "01 09:00:00", "OFFLINE"), ("s", "a", "01 10:00:00", "RESTORING"), ("s", "a", "01 11:00:00", "online"), ("s", "a", "01 12:00:00", "SUSPECT"),
        ("s", "b", "01 10:00:00", "ONLINE"), ("s", "c", "01 11:00:00", "Recovery Pending"), ("s", "d", "01 11:00:00", None),
        ("s", "e", "01 11:00:00", "RESTORING"), ("s", "e", "01 17:00:00", "ONLINE"), ("s", "f", "01 09:59:00", "ONLINE"),
        ("s", "g", "01 12:00:00", "ONLINE"), ("s", "g", "01 12:00:00", "OFFLINE"), ("s", "h", "01 16:00:00", "ONLINE"), ("s", None, "01 16:00:00", "ONLINE"),
    ], at)
    got = rechecks.restore_outcomes(spark.createDataFrame(restores, RESTORE), spark.createDataFrame(snaps, STATE))
    assert {r.event_id: (r.outcome, r.ended_at.hour) for r in got.collect()} == {
        0: ("online", 11), 1: ("online", 10), 2: ("not online", 11), 3: ("unknown", 11), 4: ("unfinished", 16), 5: ("gone", 16),
        6: ("not online", 12), 7: ("online", 16), 20: ("online", 11),
    }
    assert sorted(r.event_id for r in rechecks.outcome_alerts(got).collect()) == [2, 3, 4, 5, 6]
    empty = rechecks.restore_outcomes(spark.createDataFrame([], RESTORE), spark.createDataFrame([], STATE))
    assert empty.count() == 0


def test_every_delivery_judges_the_open_restores_again(spark, at):
    """Each restore is alerted once, in the run whose snapshots end it; all runs together are the batch form."""
    events, snaps = stage_path(spark, "restores"), stage_path(spark, "states")
    out, offsets = stage_path(spark, "outcomes"), stage_path(spark, "outcomes-offsets")
    days = [
        ([("s", "a", 1, "01 10:00:00"), ("s", "b", 2, "01 10:00:00")], [("s", "a", "01 10:30:00", "RESTORING"), ("s", "b", "01 10:30:00", "ONLINE")]),
        ([("s", "c", 3, "01 12:00:00")], [("s", "a", "01 12:30:00", "RECOVERING"), ("s", "z", "01 12:30:00", "ONLINE")]),
        ([("s", "z", 4, "01 20:00:00")], [("s", "a", "01 14:00:00", "OFFLINE"), ("s", "z", "01 20:30:00", "RESTORING")]),
    ]
    ended, all_restores, all_states = [], [], []
    for restores, rows in days:
        restores, rows = [(s, d, i, at(f"2024-01-{t}")) for s, d, i, t in restores], states(rows, at)
        all_restores += restores
        all_states += rows
        spark.createDataFrame(restores, RESTORE).coalesce(1).write.mode("append").parquet(events)
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(snaps)
        stream = rechecks.restore_outcomes_stream(read_files(spark, events), read_files(spark, snaps))
        sink = run_to_parquet(stream, "outcomes", path=out, checkpoint=offsets)
        ended.append({r.event_id: r.outcome for r in sink.collect()})
    assert ended == [{}, {2: "online"}, {1: "not online", 2: "online", 3: "gone"}]
    rest = rechecks.open_outcomes(spark, offsets, timeout="6 hours")
    assert [(r.event_id, r.outcome) for r in rest.collect()] == [(4, "unfinished")]
    whole = rechecks.restore_outcomes(spark.createDataFrame(all_restores, RESTORE), spark.createDataFrame(all_states, STATE))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sink.unionByName(rest).collect()))


def test_a_restore_at_the_end_of_its_wait(spark, at):
    end = at("2024-01-01 10:00:00") + dt.timedelta(hours=6)
    restores = spark.createDataFrame([("s", "a", 1, at("2024-01-01 10:00:00"))], RESTORE)
    inside = spark.createDataFrame([("s", "a", end, "ONLINE")], STATE)
    beyond = spark.createDataFrame([("s", "a", end + dt.timedelta(microseconds=1), "ONLINE")], STATE)
    assert rechecks.restore_outcomes(restores, inside).first().outcome == "online"
    assert rechecks.restore_outcomes(restores, beyond).first().outcome == "gone"
