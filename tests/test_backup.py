import pytest
from pyspark.sql import functions as F

from fleetlens.operators import backup as b
from fleetlens.operators import restore as r

SETS = (
    "server_name string, backup_set_id bigint, media_set_id bigint, database_name string, database_guid int, type string, backup_start_date timestamp_ntz, "
    "backup_finish_date timestamp_ntz, is_copy_only int, recovery_model string, first_lsn bigint, last_lsn bigint, backup_size bigint, compressed_backup_size bigint, name string, user_name string"
)
MEDIA = "server_name string, media_set_id bigint, family_sequence_number int, device_type int, mirror int, physical_device_name string"
DATABASES = "server_name string, database_name string, database_guid int, state_desc string, recovery_model_desc string, is_read_only int, is_in_standby int, source_database_guid int, last_log_backup_lsn bigint"


@pytest.fixture()
def world(spark, at):
    def set_(i, kind, day, lsn, db="a", guid=1, copy=0, name=None, model="FULL"):
        t = at(f"2024-01-{day:02d} 00:00:00")
        return ("s", i, i, db, guid, kind, t, t, copy, model, lsn, lsn + 5, 10_000_000, None, name, "u")

    sets = [
        set_(1, "L", 1, 5), set_(2, "D", 2, 10), set_(3, "L", 3, 20), set_(4, "I", 4, 30), set_(5, "L", 5, 40),
        set_(6, "D", 6, 50), set_(7, "L", 7, 60), set_(8, "D", 8, 70, copy=1), set_(9, "D", 9, 80, db="late", guid=2),
        set_(10, "D", 3, 15, name="archive"), set_(11, "D", 1, 1, db="gone", guid=3),
    ]
    media = [("s", i, n, 2, 0, f"E:\\{i}_{n}.bak") for i in range(1, 12) for n in (1, 2)] + [("s", 6, 1, 2, 1, "M:\\6.bak")]
    files = [("s", 6, "data", "D", "C:\\x\\a.mdf"), ("s", 6, "log", "L", "C:\\x\\a.ldf"), ("s", 6, "ft", "F", "C:\\x\\ft")]
    databases = [("s", "a", 1, "ONLINE", "FULL", 0, 0, None, None), ("s", "late", 2, "ONLINE", "FULL", 0, 0, None, 5)]
    return (
        spark.createDataFrame(sets, SETS), spark.createDataFrame(media, MEDIA),
        spark.createDataFrame(files, "server_name string, backup_set_id bigint, logical_name string, file_type string, physical_name string"),
        spark.createDataFrame(databases, DATABASES),
    )


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_retention_parts_are_disjoint_and_complete(world, rows):
    sets, media, _, databases = world
    files = b.backup_files_retention(sets, media, databases, cutoff=_ts("2024-01-06 00:00:00"))
    gone, kept = b.deletable_backup_files(files), b.current_backup_files(files)
    assert files.count() == gone.count() + kept.count()
    assert {r.physical_device_name for r in gone.collect()} == {f"E:\\{i}_{n}.bak" for i in (1, 2, 3, 4, 5) for n in (1, 2)}
    # no full before the cutoff: the database is not in the view at all; archives never are
    assert "late" not in {r.database_name for r in files.collect()}
    assert not [r for r in files.collect() if r.name == "archive"]


def test_cutoff_is_strict_only_where_it_should_be(world, rows):
    sets, media, _, databases = world
    inclusive = b.baseline_full_backups(sets, media, databases, cutoff=_ts("2024-01-06 00:00:00"))
    strict = b.oldest_full_backup_dates(sets, media, databases, keep_date=_ts("2024-01-06 00:00:00"))
    assert [str(r[1]) for r in rows(inclusive.drop("server_name"))] == ["2024-01-06 00:00:00"]
    assert [str(r[1]) for r in rows(strict.drop("server_name"))] == ["2024-01-03 00:00:00"]


def test_restore_script_lines(world):
    sets, media, files, databases = world
    lines = r.restore_commands(sets, media, files, databases, database="a", data_path="D:\\d", log_path="L:\\l\\")
    text = [x.command for x in lines.orderBy("cmd_order", "seq", "command").collect()]
    assert text[0] == "RESTORE DATABASE a" and text[1] == "FROM"
    assert "\tDISK = 'E:\\6_1.bak'," in text and "\tDISK = 'E:\\6_2.bak'" in text
    assert "\tMOVE 'data' TO 'D:\\d\\a.mdf'," in text and "\tMOVE 'log' TO 'L:\\l\\a.ldf'," in text and "\tMOVE 'ft' TO 'D:\\d\\ft'," in text
    with pytest.raises(ValueError):
        r.restore_commands(sets, media, files, databases, backup_type="L")


def test_first_log_is_dropped_and_stopat_ends_the_chain(spark, world, at):
    sets, media, files, databases = world
    requests = spark.createDataFrame([("s", "a", at("2024-01-04 12:00:00"))], "server_name string, database_name string, as_of timestamp_ntz")
    points = r.restore_points(sets, databases, requests)
    p = points.first()
    assert (p.full_media_set_id, p.diff_media_set_id, p.base_lsn) == (10, 4, 35)
    logs = [x.media_set_id for x in r.chain_logs(sets, points).collect()]
    assert logs == [5]
    chain = r.restore_chain_asof(sets, media, files, databases, requests)
    stop = [x.command for x in chain.where("cmd_order = 12").collect()]
    assert len(stop) == 2 and all("STOPAT = '2024-01-04 12:00:00'" in s for s in stop)
    early = spark.createDataFrame([("s", "a", at("2024-01-02 12:00:00"))], requests.schema)
    found = {x.media_set_id for x in r.chain_logs(sets, r.restore_points(sets, databases, early)).collect()}
    assert found == {3}  # log 1 has no log before it


def test_checks_per_request(spark, world, at):
    sets, _, _, databases = world
    asked = [("s", "nope", at("2024-01-05 00:00:00")), ("s", "a", at("2024-02-01 00:00:00")), ("s", "a", at("2024-01-06 12:00:00")), ("s", "a", at("2024-01-07 12:00:00")), ("s", "late", at("2024-01-01 00:00:00"))]
    requests = spark.createDataFrame(asked, "server_name string, database_name string, as_of timestamp_ntz")
    out = {(x.database_name, str(x.as_of)): (x.status, x.stop) for x in r.restore_chain_checks(sets, databases, requests, now=_ts("2024-01-20 00:00:00")).collect()}
    assert out["nope", "2024-01-05 00:00:00"] == ("unknown database", True)
    assert out["a", "2024-02-01 00:00:00"] == ("future point in time", True)
    assert out["a", "2024-01-06 12:00:00"] == ("ok", False)
    assert out["a", "2024-01-07 12:00:00"] == ("take a tail log backup", True)
    assert out["late", "2024-01-01 00:00:00"] == ("log chain is broken", False)


def test_size_report_divides_by_copies(world):
    sets, media, _, databases = world
    row = b.last_backups_report(sets, media, databases).where("database_name = 'a'").first()
    assert (row.size_mb_full, row.files_full) == ("4.77", "E:\\6_1.bak,E:\\6_2.bak")
    assert row.completed_diff is None  # older than the full


def test_zero_size_backup_gives_no_ratio(spark, world):
    sets, _, _, databases = world
    zero = sets.withColumn("backup_size", F.lit(0).cast("bigint")).withColumn("compressed_backup_size", F.lit(1).cast("bigint"))
    pages = spark.createDataFrame([("s", "a", 1, 131072 * 40)], "server_name string, database_name string, container_id bigint, total_pages bigint")
    estimate = b.backup_size_estimate(pages, zero, databases)
    assert [(str(x.size_gb), x.compressed_size_gb) for x in estimate.collect()] == [("40.0000", None)]
    assert b.backup_stripe_plan(estimate, now=_ts("2024-01-01 00:00:00")).count() == 2
    archive = b.backup_stripe_plan(estimate, now=_ts("2024-01-01 00:00:00"), archive=True)
    assert archive.count() == 10 and archive.first().file_name == "a 2024-01-01.Monday.Archive.1.bak"


def test_action_plan(spark, world, rows):
    sets, _, _, databases = world
    plan = b.backup_action_plan(databases, sets, request="LOG")
    assert rows(plan, "database_name", "step", "action") == [("a", 0, "DIFF"), ("a", 1, "LOG"), ("late", 0, "LOG")]
    assert rows(b.backup_action_plan(databases, sets.where("database_name = 'a'"), request="DIFF"), "database_name", "action") == [("a", "DIFF"), ("late", "FULL")]
