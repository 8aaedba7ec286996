"""Streams give what the batch form gives on the same rows."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts as a
from fleetlens.session import stage_path
from fleetlens.sources import shred
from fleetlens.sources.fixtures import Fixtures
from fleetlens.streaming import handlers as h
from fleetlens.streaming import stateful
from fleetlens.streaming.runs import read_files, run_to_parquet

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Fixtures(spark, SF_DIR)


@pytest.fixture(scope="module")
def messages(spark, t):
    """The event messages as four files, newest rows first."""
    path = tempfile.mkdtemp(prefix="messages-")
    rows = t("fx_server_event_xml")
    for part in range(4):
        rows.where(F.col("event_id") % 4 == 3 - part).coalesce(1).write.mode("append").parquet(path)
    return path


HANDLERS = {
    "backup": lambda e, t: h.backup_restore_alerts(e, t("fx_databases")),
    "recheck": lambda e, t: h.restores_to_recheck(e, t("fx_databases")),
    "login": lambda e, t: h.login_alerts(e),
    "owner": lambda e, t: h.owner_change_alerts(e),
    "dbcc": lambda e, t: h.dbcc_alerts(e),
    "deadlock": lambda e, t: h.deadlock_events(e)[0],
    "deprecation": lambda e, t: h.deprecation_events(e)[1],
    "ddl": lambda e, t: h.ddl_audit_log(e, t("fx_shipped_object")),
    "security": lambda e, t: h.security_ddl_audit(e),
    "roles": lambda e, t: h.role_policy_violations(e),
    "alter": lambda e, t: h.alter_database_policy(e),
    "drop": lambda e, t: h.drop_database_policy(e),
    "instance": lambda e, t: h.instance_change_alerts(e),
    "quarantine": lambda e, t: h.quarantined_events(e),
    "window": lambda e, t: h.maintenance_window_filter(h.good_events(e)).drop("event"),
}


@pytest.mark.parametrize("name", HANDLERS)
def test_handler_stream_equals_batch(spark, t, messages, rows, name):
    stream = shred.server_event_shred(read_files(spark, messages, files_per_trigger=2))
    batch = shred.server_event_shred(spark.read.parquet(messages))
    assert rows(run_to_parquet(HANDLERS[name](stream, t), name)) == rows(HANDLERS[name](batch, t))


def test_second_run_takes_only_new_files(spark, messages, rows):
    source = tempfile.mkdtemp(prefix="source-")
    out, offsets = stage_path(spark, "out"), stage_path(spark, "offsets")
    files = sorted(f for f in os.listdir(messages) if f.endswith(".parquet"))
    total = 0
    for name in files[:2]:
        shutil.copy(f"{messages}/{name}", source)
        stream = shred.server_event_shred(read_files(spark, source)).drop("event")
        total = run_to_parquet(stream, "events", path=out, checkpoint=offsets).count()
    assert total == spark.read.parquet(source).count()


def _write_in_files(df, order_column, files, *, shuffled):
    """The rows as files in time order, or with every second pair of files swapped."""
    path = tempfile.mkdtemp(prefix="stream-")
    low, high = df.agg(F.min(order_column), F.max(order_column)).first()
    step = (high - low) / files
    order = list(range(files))
    if shuffled:
        order[1], order[2] = order[2], order[1]
    for i in order:
        last = i == files - 1
        upper = F.lit(True) if last else F.col(order_column) < F.lit(low + step * (i + 1)).cast("timestamp_ntz")
        lower = F.col(order_column) >= F.lit(low + step * i).cast("timestamp_ntz")
        df.where(lower & upper).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("shuffled", [False, True])
def test_throttle_stream_equals_batch(spark, t, rows, at, shuffled):
    alerts = a.alert_rule_match(t("fx_alert_event"), a.standard_rules(spark)).withColumn("delay_seconds", F.lit(43200))
    # a closing alert far in the future lets the watermark pass every real one
    close = alerts.limit(1).withColumns({"ts": F.lit(at("2030-01-01 00:00:00")).cast("timestamp_ntz"), "alert_name": F.lit("close")})
    path = _write_in_files(alerts, "ts", 4, shuffled=shuffled)
    offsets, out = stage_path(spark, "offsets"), stage_path(spark, "out")

    def run():
        stream = read_files(spark, path, files_per_trigger=1)
        return run_to_parquet(stateful.alert_throttle_stream(stream, lateness="20 days"), "throttle", path=out, checkpoint=offsets)

    run()
    close.coalesce(1).write.mode("append").parquet(path)
    assert rows(run()) == rows(a.alert_throttle(alerts))


def test_throttle_tail_completes_each_run(spark, t, rows):
    """No closing alert: after every run the sink and the tail are the batch result of what was read."""
    alerts = a.alert_rule_match(t("fx_alert_event"), a.standard_rules(spark)).withColumn("delay_seconds", F.lit(43200))
    files, path = _write_in_files(alerts, "ts", 4, shuffled=False), tempfile.mkdtemp(prefix="tail-")
    offsets, out = stage_path(spark, "offsets"), stage_path(spark, "out")
    names = sorted((f for f in os.listdir(files) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{files}/{f}"))
    for part in (names[:2], names[2:]):
        for name in part:
            shutil.copy(f"{files}/{name}", path)
            second = 1_700_000_000 + names.index(name)  # the source takes files by their time
            os.utime(f"{path}/{name}", (second, second))
        stream = stateful.alert_throttle_stream(read_files(spark, path, files_per_trigger=1), lateness="2 days")
        passed = run_to_parquet(stream, "throttle", path=out, checkpoint=offsets)
        whole = a.alert_throttle(spark.read.parquet(path))
        assert passed.count() < whole.count()
        assert rows(passed.unionByName(stateful.throttle_tail(spark, offsets))) == rows(whole)
    assert stateful.throttle_tail(spark, stage_path(spark, "never-run")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_free_space_stream_equals_batch(spark, t, rows, at, shuffled):
    samples = t("fx_drive_sample")
    path = _write_in_files(samples, "sample_time", 4, shuffled=shuffled)
    offsets, out = stage_path(spark, "offsets"), stage_path(spark, "out")
    close = samples.limit(1).withColumns({"sample_time": F.lit(at("2030-01-01 00:00:00")).cast("timestamp_ntz"), "drive": F.lit("Z"), "mb_free": F.lit(1)})

    def run():
        stream = read_files(spark, path, files_per_trigger=1)
        updates = stateful.free_space_updates_stream(stream, repeat_minutes=150, lateness="20 days")
        return run_to_parquet(updates, "drives", path=out, checkpoint=offsets)

    run()
    close.coalesce(1).write.mode("append").parquet(path)
    assert rows(run()) == rows(a.free_space_updates(samples, repeat_minutes=150))


def test_counter_stream_emits_finished_days(spark, t, rows):
    alerts = a.alert_rule_match(t("fx_alert_event"), a.standard_rules(spark))
    path = _write_in_files(alerts, "ts", 2, shuffled=False)
    got = run_to_parquet(stateful.occurrence_counter_stream(read_files(spark, path)), "counter")
    last_day = alerts.agg(F.date_trunc("day", F.max("ts"))).first()[0].replace(tzinfo=None)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    whole = alerts.where(day < F.lit(last_day).cast("timestamp_ntz")).groupBy("server_name", "alert_name", day.alias("day")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last")
    )
    assert rows(got) == rows(whole)
