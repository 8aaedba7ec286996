"""Restore command text from backup history.

Scripts come as ordered lines (cmd_order, seq) and not as one text value, so a
database with any number of files or logs stays a set of rows.  Nothing runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.joins import reduced_side
from fleetlens.functions.ordered import asof_latest, latest_so_far
from fleetlens.operators.backup import DB, MEDIA, last_full_backup

GUID = ["server_name", "database_guid"]
# fixed comment line of the generated scripts
MOVE_NOTE = tx.TAB + "--TODO: replace the source database file paths below with the database file paths for the target."


def _order(n: str) -> Column:
    return F.lit(n).cast("decimal(3,1)").alias("cmd_order")


def _line(df: DataFrame, keys: list[str], order: str, text: Column, seq: Column | None = None) -> DataFrame:
    return df.select(
        *keys, _order(order), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"), text.alias("command")
    )


def _fixed_lines(df: DataFrame, keys: list[str], lines: list[tuple[str, Column]]) -> DataFrame:
    """Lines that need only the row itself, in one pass; NULL texts are left out."""
    rows = F.array(*[
        F.struct(_order(n), F.lit(0).cast("bigint").alias("seq"), text.alias("command")) for n, text in lines
    ])
    return df.select(*keys, F.inline(F.filter(rows, lambda x: x["command"].isNotNull())))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _disk_lines(sets: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """One DISK line per file; a comma follows unless the file has the top number.

    ``sets`` holds (keys, cmd_order, media_set_id); the media are read once.
    """
    keys = [*keys, "cmd_order"]
    # a window is safe here: its group is the files of one backup, 64 at most per set
    top = F.max("family_sequence_number").over(Window.partitionBy(*keys))
    rows = sets.join(files, MEDIA).withColumn("_last", top)
    text = F.concat(
        F.lit(tx.TAB + "DISK = '"), F.col("physical_device_name"), F.lit("'"),
        F.when(F.col("family_sequence_number") == F.col("_last"), F.lit("")).otherwise(F.lit(",")),
    )
    seq = F.col("media_set_id") * 1000 + F.col("family_sequence_number")
    return rows.select(*keys, seq.cast("bigint").alias("seq"), text.alias("command"))


def _move_target(data_path: str, log_path: str) -> Column:
    name = tx.basename("physical_name")
    target = F.col("physical_name")
    if data_path:
        target = F.concat(F.lit(data_path), name)
    if log_path:
        target = F.when(F.col("file_type") == "L", F.concat(F.lit(log_path), name)).otherwise(target)
    return target


def restore_commands(
    backupset: DataFrame,
    media: DataFrame,
    backupfile: DataFrame,
    databases: DataFrame,
    *,
    backup_type: str = "D",
    database: str | None = None,
    data_path: str | None = None,
    log_path: str | None = None,
    device_types: tuple[int, ...] | None = (2,),
) -> DataFrame:
    """Lines of the restore script of the last full or differential backup.

    Sets that share the chosen finish are all used, whatever their type, as the
    script is keyed by the finish date.
    """
    last = reduced_side(last_full_backup(
        backupset, media, databases, backup_type=backup_type, database=database, device_types=device_types
    ))
    sets = reduced_side(
        backupset.select(*DB, "media_set_id", "backup_set_id", "backup_finish_date").join(last, [*DB, "backup_finish_date"])
    )
    disks = media if device_types is None else media.where(F.col("device_type").isin(*device_types))
    full = backup_type == "D"
    parts = [
        _fixed_lines(last, DB, [
            ("1", F.concat(F.lit("RESTORE DATABASE "), F.col("database_name"))),
            ("2", F.lit("FROM")),
            ("4", F.lit("WITH ")),
            ("4.5", F.lit(MOVE_NOTE if full else None).cast("string")),
            ("6", F.lit(tx.TAB + "REPLACE, NORECOVERY " + tx.CRLF + tx.CRLF)),
        ]),
        _disk_lines(sets.select(*DB, _order("3"), "media_set_id"), disks, DB),
    ]
    if full:
        moved = sets.join(backupfile, ["server_name", "backup_set_id"])
        target = _move_target(tx.with_backslash(data_path), tx.with_backslash(log_path))
        text = F.concat(F.lit(tx.TAB + "MOVE '"), F.col("logical_name"), F.lit("' TO '"), target, F.lit("',"))
        parts.append(_line(moved, DB, "5", text, F.col("backup_set_id")))
    return _union(parts)


def restore_log_commands(
    backupset: DataFrame, media: DataFrame, databases: DataFrame, *, database: str | None = None
) -> DataFrame:
    """Commands for every set that finished after the last full or differential."""
    scope = databases if database is None else databases.where(F.col("database_name") == database)
    last = reduced_side(
        backupset.where(F.col("type").isin("D", "I") & (F.col("is_copy_only") == 0))
        .join(scope.select(*DB), DB, "left_semi")
        .groupBy(*DB)
        .agg(F.max("backup_finish_date").alias("last_backup"))
    )
    later = backupset.join(last, DB).where(F.col("backup_finish_date") > F.col("last_backup"))
    text = F.concat(
        F.lit("RESTORE DATABASE "), F.col("database_name"), F.lit(tx.CRLF + tx.TAB + "FROM DISK = '"),
        F.col("physical_device_name"), F.lit("'" + tx.CRLF + "WITH REPLACE, NORECOVERY " + tx.CRLF + tx.CRLF),
    )
    return later.join(media, MEDIA).select(
        *DB, "backup_finish_date", "media_set_id", "family_sequence_number", text.alias("command")
    )


def restore_script_all(
    backupset: DataFrame, media: DataFrame, backupfile: DataFrame, databases: DataFrame, *, database: str | None = None
) -> DataFrame:
    """Full, differential and log sections, in script order."""
    sections = []
    for section, kind in ((1, "D"), (2, "I")):
        lines = restore_commands(backupset, media, backupfile, databases, backup_type=kind, database=database)
        sections.append(lines.withColumn("section", F.lit(section)).withColumn("at", F.lit(None).cast("timestamp_ntz")))
    logs = restore_log_commands(backupset, media, databases, database=database).select(
        *DB, _order("1"), (F.col("media_set_id") * 1000 + F.col("family_sequence_number")).alias("seq"),
        "command", F.lit(3).alias("section"), F.col("backup_finish_date").alias("at"),
    )
    return _union([*sections, logs]).orderBy(*DB, "section", "at", "cmd_order", "seq", "command")


def restore_points(backupset: DataFrame, databases: DataFrame, requests: DataFrame) -> DataFrame:
    """Base full and, if any, the differential after it for each (database, as_of).

    Both lookups are as-of reads in time order over (database, month) blocks.
    """
    named = requests.select(*DB, "as_of").distinct().join(databases.select(*DB, "database_guid"), DB)
    payload = ["media_set_id", "recovery_model", "last_lsn", "backup_set_id"]
    history = backupset.where(F.col("is_copy_only") == 0)
    found = asof_latest(
        history.where("type = 'D'"), named, GUID, "backup_finish_date", "as_of", payload, ties=["backup_set_id"]
    ).where(F.col("asof").isNotNull()).withColumnRenamed("asof", "f")
    both = asof_latest(
        history.where("type = 'I'"), found, GUID, "backup_finish_date", "as_of", payload, ties=["backup_set_id"]
    )
    diff = F.when(F.col("asof.at") > F.col("f.at"), F.col("asof"))
    return both.select(
        *DB, "database_guid", "as_of",
        F.col("f.at").alias("full_finish"), F.col("f.media_set_id").alias("full_media_set_id"),
        F.col("f.recovery_model").alias("full_recovery_model"),
        diff["at"].alias("diff_finish"), diff["media_set_id"].alias("diff_media_set_id"),
        F.coalesce(diff["recovery_model"], F.col("f.recovery_model")).alias("recovery_model"),
        F.coalesce(diff["last_lsn"], F.col("f.last_lsn")).alias("base_lsn"),
    )


def chain_logs(backupset: DataFrame, points: DataFrame) -> DataFrame:
    """Log sets each restore point needs.

    A log counts when it reaches the base position and the log before it (strictly
    earlier finish) finished before the requested time; the very first log of a
    database has no log before it and never counts.  Each (database, month) block
    is summarised first, and only blocks that can hold a needed log are joined, so
    the join follows the size of the result.
    """
    logs = backupset.where("type = 'L'").select(
        *GUID, "media_set_id", "backup_set_id", "backup_finish_date", "first_lsn", "last_lsn"
    )
    finishes = logs.select(*GUID, "backup_finish_date").distinct()
    previous = latest_so_far(finishes, GUID, "backup_finish_date", "backup_finish_date", "prev_finish", strict=True)
    month = F.date_trunc("month", F.col("backup_finish_date")).cast("timestamp_ntz")
    logs = (
        logs.join(previous, [*GUID, "backup_finish_date"])
        .where(F.col("prev_finish").isNotNull())
        .withColumn("month", month)
        .withColumn("top_lsn", F.greatest("first_lsn", "last_lsn"))
    )
    blocks = logs.groupBy(*GUID, "month").agg(
        F.max("top_lsn").alias("block_lsn"), F.min("prev_finish").alias("block_prev")
    )
    wanted = (
        points.join(blocks, GUID)
        .where((F.col("block_lsn") >= F.col("base_lsn")) & (F.col("block_prev") < F.col("as_of")))
        .drop("block_lsn", "block_prev")
    )
    return wanted.join(logs, [*GUID, "month"]).where(
        (F.col("top_lsn") >= F.col("base_lsn")) & (F.col("prev_finish") < F.col("as_of"))
    ).drop("month", "top_lsn")


def restore_chain_asof(
    backupset: DataFrame, media: DataFrame, backupfile: DataFrame, databases: DataFrame, requests: DataFrame
) -> DataFrame:
    """Lines of the point-in-time script for every (database, as_of) request."""
    keys = [*DB, "as_of"]
    # one row per request, used four times below
    points = reduced_side(restore_points(backupset, databases, requests))
    name = F.concat(F.lit("RESTORE DATABASE "), F.col("database_name"))
    go = "GO" + tx.CRLF + tx.CRLF

    def if_diff(text: Column) -> Column:
        return F.when(F.col("diff_finish").isNotNull(), text)

    fixed = _fixed_lines(points, keys, [
        ("1", name),
        ("2", F.lit("FROM")),
        ("4", F.lit("WITH ")),
        ("4.5", F.lit(MOVE_NOTE)),
        ("6", F.lit(tx.TAB + "REPLACE, NORECOVERY ")),
        ("7", F.lit(go)),
        ("8", if_diff(name)),
        ("9", if_diff(F.lit("FROM"))),
        ("11", if_diff(F.lit("WITH REPLACE, NORECOVERY" + tx.CRLF + go))),
    ])
    sets = points.select(*keys, F.inline(F.array(
        F.struct(_order("3"), F.col("full_media_set_id").alias("media_set_id")),
        F.struct(_order("10"), F.col("diff_media_set_id").alias("media_set_id")),
    )))

    full_sets = backupset.select(*GUID, "backup_set_id", F.col("backup_finish_date").alias("full_finish"))
    moved = points.join(full_sets, [*GUID, "full_finish"]).join(backupfile, ["server_name", "backup_set_id"])
    move = F.concat(F.lit(tx.TAB + "MOVE '"), F.col("logical_name"), F.lit("' TO '"), F.col("physical_name"), F.lit("',"))
    logs = chain_logs(backupset, points).join(media, MEDIA)
    stop = F.when(
        F.col("backup_finish_date") > F.col("as_of"),
        F.concat(F.lit(", STOPAT = '"), F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), F.lit("'")),
    ).otherwise(F.lit(""))
    log_text = F.concat(
        name, F.lit(tx.CRLF + tx.TAB + "FROM DISK = '"), F.col("physical_device_name"),
        F.lit("'" + tx.CRLF + "WITH REPLACE, NORECOVERY "), stop, F.lit(tx.CRLF + tx.CRLF),
    )
    # the finish leads the order of the log lines; files of one log follow its sequence
    log_seq = F.unix_seconds(F.col("backup_finish_date").cast("timestamp")) * 100000 + F.col("family_sequence_number")
    return _union([
        fixed,
        _disk_lines(sets, media, keys),
        _line(moved, keys, "5", move, F.col("backup_set_id")),
        _line(logs, keys, "12", log_text, log_seq),
    ])


def restore_chain_checks(
    backupset: DataFrame, databases: DataFrame, requests: DataFrame, *, now: Column
) -> DataFrame:
    """One status per request instead of a raised error.

    ``stop`` means that no script may be used; warnings still give one.
    """
    asked = requests.select(*DB, "as_of").distinct()
    known = databases.select(*DB, "database_guid", "recovery_model_desc")
    points = restore_points(backupset, databases, requests).select(
        *DB, "as_of", "recovery_model", F.lit(True).alias("has_base")
    )
    last_log = (
        backupset.where("type = 'L'").join(databases.select(*GUID), GUID, "left_semi")
        .groupBy(*DB).agg(F.max("backup_finish_date").alias("last_log"))
    )
    no_log = F.col("last_log").isNull() | (F.col("last_log") < F.col("as_of"))
    broken = F.col("has_base").isNull() | F.coalesce(F.col("recovery_model") != "FULL", F.lit(True))
    status = (
        F.when(F.col("database_guid").isNull(), F.lit("unknown database"))
        .when(F.col("as_of") >= now, F.lit("future point in time"))
        .when(broken, F.lit("log chain is broken"))
        .when(no_log & (F.col("recovery_model_desc") == "FULL"), F.lit("take a tail log backup"))
        .when(no_log, F.lit("no log backup since"))
        .otherwise(F.lit("ok"))
    )
    stop = F.col("status").isin("unknown database", "future point in time", "take a tail log backup")
    return (
        asked.join(known, DB, "left").join(points, [*DB, "as_of"], "left").join(last_log, DB, "left")
        .select(*DB, "as_of", status.alias("status"))
        .withColumn("stop", stop)
    )
