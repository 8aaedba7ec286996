"""Backup-history analytics: last backups, retention, reports and plans.

History rows are keyed by (server_name, database_name); media sets by
(server_name, media_set_id).  All maxima are plain grouped aggregates, so they
combine on the map side and a hot database costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.joins import reduced_side, small_side
from fleetlens.session import cut

DB = ["server_name", "database_name"]
MEDIA = ["server_name", "media_set_id"]
NEVER_BACKED_UP = ("tempdb", "model")


def _check_type(backup_type: str, allowed: tuple[str, ...]) -> None:
    if backup_type not in allowed:
        raise ValueError(f"backup type {backup_type!r} is not one of {allowed}")


def _only(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Optional filter: no predicate when the argument is absent."""
    return df if value is None else df.where(F.col(column) == value)


def disk_media_sets(media: DataFrame, device_types: tuple[int, ...]) -> DataFrame:
    """Media sets with a file on one of the device types, once each."""
    return media.where(F.col("device_type").isin(*device_types)).select(*MEDIA).distinct()


def last_full_backup(
    backupset: DataFrame,
    media: DataFrame,
    databases: DataFrame,
    *,
    backup_type: str = "D",
    database: str | None = None,
    device_types: tuple[int, ...] | None = (2,),
) -> DataFrame:
    """Latest finish per existing database for one backup type, not copy-only.

    ``device_types=None`` drops the condition on the media.
    """
    _check_type(backup_type, ("D", "I"))
    history = _only(backupset, "database_name", database).where(
        (F.col("type") == backup_type) & (F.col("is_copy_only") == 0)
    )
    if device_types is not None:
        history = history.join(disk_media_sets(media, device_types), MEDIA, "left_semi")
    return (
        history.join(databases.select(*DB), DB, "left_semi")
        .groupBy(*DB)
        .agg(F.max("backup_finish_date").alias("backup_finish_date"))
    )


def _last_full_by_guid(
    backupset: DataFrame, media: DataFrame, databases: DataFrame, device_types: tuple[int, ...]
) -> DataFrame:
    return (
        backupset.where((F.col("type") == "D") & (F.col("is_copy_only") == 0))
        .join(disk_media_sets(media, device_types), MEDIA, "left_semi")
        .join(databases.select("server_name", "database_guid"), ["server_name", "database_guid"], "left_semi")
        .groupBy("server_name", "database_guid")
        .agg(F.max("backup_finish_date").alias("last_full"))
    )


def baseline_full_backups(
    backupset: DataFrame,
    media: DataFrame,
    databases: DataFrame,
    *,
    cutoff: Column,
    inclusive: bool = True,
    device_types: tuple[int, ...] = (2, 102),
) -> DataFrame:
    """Latest full backup at or before the cutoff and the last full, per database.

    ``inclusive=False`` makes both comparisons strict.
    """
    last = reduced_side(_last_full_by_guid(backupset, media, databases, device_types))
    finish = F.col("backup_finish_date")
    if inclusive:
        early = (finish <= cutoff) & (finish <= F.col("last_full"))
    else:
        early = (finish < cutoff) & (finish < F.col("last_full"))
    return (
        backupset.where((F.col("type") == "D") & (F.col("is_copy_only") == 0))
        .join(last, ["server_name", "database_guid"])
        .where(early)
        .groupBy("server_name", "database_guid")
        .agg(F.max("backup_finish_date").alias("baseline"))
    )


def oldest_full_backup_dates(
    backupset: DataFrame, media: DataFrame, databases: DataFrame, *, keep_date: Column
) -> DataFrame:
    """Latest full strictly before the keep date and strictly before the last full."""
    return baseline_full_backups(
        backupset, media, databases, cutoff=keep_date, inclusive=False
    ).withColumnRenamed("baseline", "backup_finish_date")


def backup_files_retention(
    backupset: DataFrame,
    media: DataFrame,
    databases: DataFrame,
    *,
    cutoff: Column,
    archive_name: str = "Archive",
    device_types: tuple[int, ...] = (2, 102),
) -> DataFrame:
    """Every full, differential and log file on disk, flagged when it may go.

    A file may go when its latest finish lies before the baseline of its
    database.  Archive sets are left out, sets without a name stay.
    """
    base = reduced_side(
        baseline_full_backups(backupset, media, databases, cutoff=cutoff, device_types=device_types)
    )
    sets = backupset.where(
        F.col("type").isin("D", "I", "L")
        & (F.col("name").isNull() | ~tx.ci_equals(F.col("name"), archive_name))
    ).select(*DB, "database_guid", "media_set_id", "type", "name", "backup_finish_date")
    files = media.where(F.col("device_type").isin(*device_types)).select(*MEDIA, "physical_device_name")
    keys = ["physical_device_name", "type", *DB, "name"]
    return (
        sets.join(base, ["server_name", "database_guid"])
        .join(files, MEDIA)
        .groupBy(*keys, "baseline")
        .agg(F.max("backup_finish_date").alias("backup_finish_date"))
        .select(*keys, "backup_finish_date", (F.col("backup_finish_date") < F.col("baseline")).alias("is_deletable"))
    )


def deletable_backup_files(files: DataFrame) -> DataFrame:
    """Files of the retention view that may be deleted, in report order."""
    return files.where("is_deletable").orderBy("name", "backup_finish_date", "physical_device_name")


def current_backup_files(files: DataFrame) -> DataFrame:
    """Files of the retention view that must stay, in report order."""
    return files.where(~F.col("is_deletable")).orderBy("name", "backup_finish_date", "physical_device_name")


def missing_backup_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that must exist but are not in the listing (server_name, path)."""
    have = listing.select("server_name", F.col("path").alias("physical_device_name"))
    return files.where(~F.col("is_deletable")).join(
        have, ["server_name", "physical_device_name"], "left_anti"
    ).select(*DB, "backup_finish_date", "physical_device_name")


def backup_file_list(media: DataFrame) -> DataFrame:
    """Comma-separated unmirrored file names per media set, in sequence order.

    A media set holds at most 64 devices, so a list is short.  Sets whose files
    are all mirrors give the empty text.
    """
    unmirrored = F.when(F.col("mirror") == 0, F.col("physical_device_name"))
    files = F.array_sort(
        F.collect_list(
            F.when(unmirrored.isNotNull(), F.struct("family_sequence_number", "physical_device_name"))
        )
    )
    return media.groupBy(*MEDIA).agg(
        F.array_join(F.transform(files, lambda f: f["physical_device_name"]), ",").alias("files")
    )


def last_backups_report(backupset: DataFrame, media: DataFrame, databases: DataFrame) -> DataFrame:
    """One row per database: last full and last differential with sizes and files.

    Fulls and differentials are reduced to one row per database each before they
    meet.  A differential older than the full shows as NULL.  Of two sets with the
    same finish the one with the higher id is shown.
    """
    details = ["backup_set_id", "media_set_id", "backup_finish_date", "name", "user_name", "backup_size", "compressed_backup_size"]
    ranked = F.struct("backup_finish_date", "backup_set_id", *[c for c in details if c not in ("backup_finish_date", "backup_set_id")])
    newest = cut(
        backupset.where(
            ((F.col("type") == "D") & (F.col("is_copy_only") == 0)) | (F.col("type") == "I")
        )
        .join(databases.select(*DB), DB, "left_semi")
        .groupBy(*DB)
        .agg(
            F.max(F.when(F.col("type") == "D", ranked)).alias("f"),
            F.max(F.when(F.col("type") == "I", ranked)).alias("i"),
        )
        .withColumn(
            "i",
            F.when(
                F.coalesce(F.col("i.backup_finish_date") < F.col("f.backup_finish_date"), F.lit(False)),
                F.lit(None),
            ).otherwise(F.col("i")),
        )
    )
    chosen = small_side(
        newest.select("server_name", F.explode(F.array("f.media_set_id", "i.media_set_id")).alias("media_set_id"))
        .where(F.col("media_set_id").isNotNull()).distinct()
    )
    # only the media of the chosen sets are aggregated
    wanted = media.join(chosen, MEDIA, "left_semi")
    facts = wanted.groupBy(*MEDIA).agg((F.max("mirror") + 1).alias("copies")).join(
        backup_file_list(wanted), MEDIA
    )

    def side(alias: str, suffix: str) -> DataFrame:
        return facts.select(
            "server_name", F.col("media_set_id").alias(f"_ms_{suffix}"),
            F.col("copies").alias(f"_copies_{suffix}"), F.col("files").alias(f"files_{suffix}"),
        )

    out = databases.where(F.col("database_name") != "tempdb").select(*DB).join(newest, DB, "left")
    for alias, suffix in (("f", "full"), ("i", "diff")):
        out = out.withColumn(f"_ms_{suffix}", F.col(f"{alias}.media_set_id")).join(
            side(alias, suffix), ["server_name", f"_ms_{suffix}"], "left"
        )

    def size(alias: str, column: str, suffix: str) -> Column:
        copies = (F.col(f"_copies_{suffix}") * 1024 * 1024).cast("decimal(18,0)")
        mb = F.col(f"{alias}.{column}").cast("decimal(20,0)") / copies
        return tx.money_text(mb)

    columns: list[Column] = [F.col(c) for c in DB]
    for alias, suffix in (("f", "full"), ("i", "diff")):
        columns += [
            F.col(f"{alias}.backup_finish_date").alias(f"completed_{suffix}"),
            F.col(f"{alias}.name").alias(f"backup_name_{suffix}"),
            F.col(f"{alias}.user_name").alias(f"backup_user_{suffix}"),
            size(alias, "backup_size", suffix).alias(f"size_mb_{suffix}"),
            size(alias, "compressed_backup_size", suffix).alias(f"size_mb_compressed_{suffix}"),
            F.col(f"files_{suffix}"),
        ]
    return out.select(*columns)


def latest_backup_media(
    backupset: DataFrame, media: DataFrame, databases: DataFrame, *, backup_type: str
) -> DataFrame:
    """Files of the latest set (by start, then id) per online database and type.

    Log requests skip databases in the SIMPLE model; a set without unmirrored
    files gives no row.
    """
    _check_type(backup_type, ("D", "I", "L"))
    candidates = databases.where(
        (F.col("state_desc") == "ONLINE") & ~F.col("database_name").isin(*NEVER_BACKED_UP)
    )
    if backup_type == "L":
        candidates = candidates.where(F.col("recovery_model_desc") != "SIMPLE")
    latest = reduced_side(
        backupset.where(F.col("type") == backup_type)
        .join(candidates.select(*DB), DB, "left_semi")
        .groupBy(*DB)
        .agg(F.max(F.struct("backup_start_date", "backup_set_id", "media_set_id")).alias("s"))
        .select(*DB, F.col("s.media_set_id").alias("media_set_id"))
    )
    files = media.where("mirror = 0").join(latest.select(*MEDIA), MEDIA, "left_semi")
    listed = backup_file_list(files)
    return latest.join(listed, MEDIA).select(
        *DB, F.lit(backup_type).alias("type"), "media_set_id", "files"
    )


def backup_size_estimate(allocation: DataFrame, backupset: DataFrame, databases: DataFrame) -> DataFrame:
    """Estimated backup size in GB and the size after compression.

    The ratio comes from the most recent full set that reports a compressed size.
    Only online databases that are not snapshots and not tempdb get a row.
    """
    live = databases.where(
        (F.col("state_desc") == "ONLINE")
        & F.col("source_database_guid").isNull()
        & (F.col("database_name") != "tempdb")
    ).select(*DB)
    gb = F.lit(1024 * 1024 * 1024).cast("decimal(20,0)")
    sizes = (
        allocation.join(live, DB, "left_semi")
        .groupBy(*DB)
        .agg((F.sum("total_pages") * 8192).cast("decimal(30,0)").alias("bytes"))
    )
    ratios = (
        backupset.where((F.col("type") == "D") & F.col("compressed_backup_size").isNotNull())
        .groupBy(*DB)
        .agg(F.max(F.struct("backup_finish_date", "backup_set_id", "compressed_backup_size", "backup_size")).alias("s"))
        .select(*DB, F.col("s.compressed_backup_size").alias("packed"), F.col("s.backup_size").alias("raw"))
    )
    ratio = F.col("packed").cast("decimal(20,0)") / F.nullif(F.col("raw"), F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return sizes.join(ratios, DB, "left").select(
        *DB,
        (F.col("bytes") / gb).cast("decimal(19,4)").alias("size_gb"),
        (ratio.cast("decimal(20,10)") * (F.col("bytes") / gb).cast("decimal(19,4)")).cast("decimal(19,4)").alias("compressed_size_gb"),
    )


def backup_stripe_plan(
    estimates: DataFrame, *, now: Column, max_file_gb: float = 4, archive: bool = False
) -> DataFrame:
    """File names of a striped backup: size over file limit, 2 to 64 files."""
    size = F.col("size_gb" if archive else "compressed_size_gb")
    limit = F.lit(str(max_file_gb)).cast("decimal(19,4)")
    count = F.least(F.lit(64), F.greatest(F.lit(2), F.coalesce(F.ceil(size / limit).cast("int"), F.lit(2))))
    kind = "Archive" if archive else "Full"
    return (
        estimates.withColumn("file_count", count)
        .withColumn("file_no", F.explode(F.sequence(F.lit(1), F.col("file_count"))))
        .select(
            *DB, "file_count", "file_no",
            F.concat(
                F.col("database_name"), F.lit(" "), F.date_format(now, "yyyy-MM-dd"), F.lit("."),
                F.date_format(now, "EEEE"), F.lit(f".{kind}."), F.col("file_no").cast("string"), F.lit(".bak"),
            ).alias("file_name"),
        )
    )


def backup_action_plan(databases: DataFrame, backupset: DataFrame, *, request: str) -> DataFrame:
    """Actions each database needs for a FULL, DIFF or LOG request, in run order.

    A differential falls back to a full when this server has no full that is not
    copy-only; a log backup takes a differential (or full) first when the log
    chain is unset; msdb goes last.
    """
    if request not in ("FULL", "DIFF", "LOG"):
        raise ValueError(f"request {request!r} is not FULL, DIFF or LOG")
    ready = databases.where((F.col("state_desc") == "ONLINE") & (F.col("is_in_standby") == 0))
    if request == "LOG":
        ready = ready.where(
            (F.col("recovery_model_desc") == "FULL") & (F.col("is_read_only") == 0)
            & ~F.col("database_name").isin("master", "tempdb", "model", "msdb")
        )
    else:
        excluded = NEVER_BACKED_UP + (("master",) if request == "DIFF" else ())
        ready = ready.where(F.col("source_database_guid").isNull() & ~F.col("database_name").isin(*excluded))
    fulls = (
        backupset.where((F.col("type") == "D") & (F.col("is_copy_only") == 0))
        .select(*DB, "database_guid").distinct().withColumn("has_full", F.lit(True))
    )
    has_full = F.coalesce("has_full", F.lit(False))
    differential = F.when(has_full, F.lit("DIFF")).otherwise(F.lit("FULL"))
    if request == "FULL":
        actions = F.array(F.lit("FULL"))
    elif request == "DIFF":
        actions = F.array(differential)
    else:
        actions = F.when(F.col("last_log_backup_lsn").isNull(), F.array(differential, F.lit("LOG"))).otherwise(
            F.array(F.lit("LOG"))
        )
    last = F.when(F.col("database_name") == "msdb", 1).otherwise(0)
    return (
        ready.join(fulls, [*DB, "database_guid"], "left")
        .select(*DB, last.alias("run_last"), F.posexplode(actions).alias("step", "action"))
        .orderBy("server_name", "run_last", "database_name", "step")
    )


def html_report(report: DataFrame, *, rows_only: bool = False) -> DataFrame:
    """The last-backups report as HTML lines, one table per server.

    Lines are rows (server_name, section, database_name, html) in document order,
    so that a server with very many databases is never held in one value.
    """
    def stamp(c: str) -> Column:
        return F.concat(F.date_format(c, "EEEE"), F.lit(" "), F.date_format(c, "MM/dd/yyyy"), F.lit("  "), F.date_format(c, "HH:mm:ss"))

    def cell(x: Column, css: str) -> Column:
        return F.concat(F.lit(f'<td class="{css}">'), F.coalesce(x, F.lit("&nbsp;")), F.lit("</td>"))

    def files(c: str) -> Column:
        listed = F.replace(F.coalesce(F.col(c), F.lit("&nbsp;")), F.lit(","), F.lit("</p><p>"))
        return F.concat(F.lit('<td class="nw"><p>'), listed, F.lit("</p></td>"))

    parts: list[Column] = [F.lit("<tr><td>"), F.col("database_name"), F.lit("</td>")]
    for suffix in ("full", "diff"):
        parts += [
            cell(stamp(f"completed_{suffix}"), "nw"),
            cell(F.col(f"size_mb_{suffix}"), "ar"),
            cell(F.col(f"size_mb_compressed_{suffix}"), "ar"),
            files(f"files_{suffix}"),
        ]
    body = report.select(
        "server_name", F.lit(2).alias("section"), "database_name", F.concat(*parts, F.lit("</tr>")).alias("html")
    )
    servers = report.select("server_name").distinct()
    band = F.concat(F.lit('<tr><th colspan="9">'), F.col("server_name"), F.lit("</th></tr>"))
    groups = F.lit('<tr><td></td><th colspan="4">FULL Backups</th><th colspan="4">DIFFERENTIAL Backups</th></tr>')
    half = ["Completion", "Size-MB", "Size-MB (compressed)", "Files"]
    names = F.lit(tx.html_header(["Database Name", *half, *half]))
    head = F.concat(F.lit("" if rows_only else '<table border="4" cellpadding="2">'), band, groups, names)
    frame = servers.select("server_name", F.lit(1).alias("section"), F.lit("").alias("database_name"), head.alias("html"))
    out = body.unionByName(frame)
    if not rows_only:
        out = out.unionByName(
            servers.select("server_name", F.lit(3).alias("section"), F.lit("").alias("database_name"), F.lit("</table>").alias("html"))
        )
    return out.orderBy("server_name", "section", "database_name")


def retention_purge(history: DataFrame, *, time_column: str, cutoff: Column, by: list[str]) -> DataFrame:
    """Rows kept and purged per group for a cutoff; ``purged_rows`` gives the rest."""
    old = F.col(time_column) < cutoff
    return history.groupBy(*by).agg(
        F.count(F.when(~old | old.isNull(), 1)).alias("kept"), F.count(F.when(old, 1)).alias("purged")
    )


def retained_rows(history: DataFrame, *, time_column: str, cutoff: Column) -> DataFrame:
    """The history without the rows older than the cutoff, for an overwrite."""
    return history.where((F.col(time_column) >= cutoff) | F.col(time_column).isNull())
