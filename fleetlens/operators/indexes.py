"""Index, storage and statistics reports over catalog snapshots.

Catalog rows are keyed by (server_name, database_name, object_id, index_id).
Lists such as key columns are grouped aggregates joined once per index; an index
has at most a few dozen columns and a few thousand partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.numbers import int_div, seconds_between

DB = ["server_name", "database_name"]
OBJECT = [*DB, "object_id"]
INDEX = [*OBJECT, "index_id"]
SYSTEM_DATABASES = ("master", "model", "msdb", "tempdb")
COMPRESSION = ("ROW", "PAGE", "NONE")


def _two_part(schema: str = "schema_name", table: str = "table_name") -> Column:
    return F.concat(tx.quotename(schema), F.lit("."), tx.quotename(table))


def _three_part() -> Column:
    return F.concat(tx.quotename("database_name"), F.lit("."), _two_part())


def _ordered_list(order: Column, text: Column, keep: Column) -> Column:
    """Comma list of the kept rows in order; NULL when none is kept."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), text.alias("t")))))
    return F.nullif(F.array_join(F.transform(rows, lambda r: r["t"]), ", "), F.lit(""))


def index_usage_report(indexes: DataFrame, partitions: DataFrame, usage: DataFrame, *, stats_date: Column) -> DataFrame:
    """One row per partition with rows of every user-table index, used or not."""
    counters = ["user_seeks", "user_scans", "user_lookups", "user_updates"]
    return (
        indexes.where((F.col("object_type") == "U") & ~F.col("database_name").isin(*SYSTEM_DATABASES))
        .select(*INDEX, "schema_name", "table_name", "index_name", "type_desc")
        .join(partitions.where("row_count > 0"), INDEX)
        .join(usage.select(*INDEX, *counters), INDEX, "left")
        .select(
            *DB, "schema_name", "table_name", F.coalesce("index_name", F.lit("")).alias("index_name"), "index_id",
            "type_desc", "partition_number", *counters, "data_compression_desc", "row_count",
            int_div(F.col("used_page_count") * 8, 1024).alias("size_mb"), "in_row_page_count",
            "overflow_page_count", "lob_page_count", stats_date.alias("stats_date"),
        )
    )


def _compression_commands() -> tuple[Column, Column]:
    """Texts that estimate the savings of row compression and that compress an index."""
    target = F.when(F.col("index_id") == 0, F.lit("TABLE ")).otherwise(
        F.concat(F.lit("INDEX "), tx.quotename("index_name"), F.lit(" ON "))
    )
    use = F.concat(F.lit("USE "), tx.quotename("database_name"), F.lit("; "))
    estimate = F.concat(
        use, F.lit("EXEC sp_estimate_data_compression_savings '"), F.col("schema_name"), F.lit("', '"), F.col("table_name"),
        F.lit("', "), F.col("index_id").cast("string"), F.lit(", NULL, 'ROW';"),
    )
    return estimate, F.concat(use, F.lit("ALTER "), target, _two_part(), F.lit(" REBUILD PARTITION = ALL WITH (DATA_COMPRESSION = ROW);"))


def index_usage_rates(report: DataFrame, *, started: Column) -> DataFrame:
    """Seeks and scans per second, minute and hour since the server started."""
    seconds = F.nullif(seconds_between(started, F.col("stats_date")), F.lit(0).cast("bigint")).cast("decimal(20,0)")

    def rate(column: str, scale: int) -> Column:
        return (F.col(column).cast("decimal(20,0)") * scale / seconds).cast("decimal(30,10)")

    estimate, enable = _compression_commands()
    return report.select(
        *DB, "table_name", "index_name", "index_id", "partition_number",
        *[rate(f"user_{kind}", scale).alias(f"{kind}_per_{unit}") for kind in ("seeks", "scans") for unit, scale in (("sec", 1), ("min", 60), ("hour", 3600))],
        estimate.alias("estimate_command"), enable.alias("enable_command"),
    )


def index_script_out(indexes: DataFrame, columns: DataFrame, partitions: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per index of a table: last uses, key and include lists, sizes, options, commands.

    The column lists come out of one grouped aggregate and the partition figures
    out of another, both on the index key, so their shuffles line up for the joins.
    """
    name = tx.quotename("column_name")
    direction = F.when(F.col("is_descending_key") == 1, F.lit(" DESC")).otherwise(F.lit(""))
    lists = columns.groupBy(*INDEX).agg(
        _ordered_list(F.col("key_ordinal"), F.concat(name, direction), F.col("key_ordinal") > 0).alias("index_keys"),
        _ordered_list(F.col("column_name"), name, F.col("is_included_column") == 1).alias("include_keys"),
        F.max(F.when(F.col("partition_ordinal") == 1, name)).alias("partition_column"),
    )

    def gb(pages: str) -> Column:
        return (F.sum(pages).cast("decimal(20,0)") * 8 / F.lit(1048576).cast("decimal(10,0)")).cast("decimal(32,2)")

    def numbers(kind: str) -> Column:
        number = F.col("partition_number")
        return _ordered_list(number, number.cast("string"), F.col("data_compression_desc") == kind)

    sums = partitions.groupBy(*INDEX).agg(
        F.count("*").alias("partition_count"), F.sum("row_count").alias("row_count"),
        gb("in_row_page_count").alias("reserved_in_row_gb"), gb("lob_page_count").alias("reserved_lob_gb"),
        numbers("ROW").alias("row_list"), numbers("PAGE").alias("page_list"),
    )
    last_read = F.greatest("last_user_seek", "last_user_scan", "last_user_lookup")

    def option(kind: str, listed: str) -> Column:
        where = F.when(F.col("partition_scheme").isNull(), F.lit("")).otherwise(
            F.concat(F.lit(" ON PARTITIONS ("), F.col(listed), F.lit(")"))
        )
        return F.when(F.col(listed).isNotNull(), F.concat(F.lit(f"DATA_COMPRESSION = {kind} "), where))

    options = F.concat_ws(", ", option("ROW", "row_list"), option("PAGE", "page_list"))
    non = F.when(F.col("index_id") > 1, F.lit("NON")).otherwise(F.lit(""))
    head = F.when(
        F.col("is_primary_key") == 1,
        F.concat(F.lit("ALTER TABLE "), _two_part(), F.lit(" ADD CONSTRAINT "), tx.quotename("index_name"), F.lit(" PRIMARY KEY "), non, F.lit("CLUSTERED ")),
    ).otherwise(F.concat(
        F.lit("CREATE "), F.when(F.col("is_unique") == 1, F.lit("UNIQUE ")).otherwise(F.lit("")), non,
        F.lit("CLUSTERED INDEX "), tx.quotename("index_name"), F.lit(" ON "), _two_part(), F.lit(" "),
    ))
    place = F.when(F.col("partition_scheme").isNull(), F.coalesce(tx.quotename("filegroup"), F.lit(""))).otherwise(
        F.concat(F.col("partition_scheme"), F.lit(" ("), F.col("partition_column"), F.lit(")"))
    )
    create = F.when(F.col("index_id") == 0, F.lit("/* No create statement (Heap) */")).otherwise(F.concat(
        head, F.lit("("), F.col("index_keys"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col("include_keys"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" WHERE "), F.col("filter_definition")), F.lit("")),
        F.when(options == "", F.lit("")).otherwise(F.concat(F.lit(" WITH ("), options, F.lit(")"))),
        F.lit(" ON "), place, F.lit(";"),
    ))
    estimate, compress = _compression_commands()
    return (
        indexes.where(F.col("type").isin(0, 1, 2, 5, 6) & (F.col("object_type") == "U"))
        .join(lists, INDEX, "left").join(sums, INDEX, "left").join(usage, INDEX, "left")
        .select(
            *DB, F.concat("schema_name", F.lit("."), "table_name").alias("table_name"), "index_id", "index_name", last_read.alias("last_user_read"),
            "last_user_seek", "last_user_scan", "last_user_lookup", "last_user_update",
            "index_keys", "include_keys", create.alias("create_statement"),
            F.concat(F.lit("DROP INDEX "), tx.quotename("index_name"), F.lit(" ON "), _two_part(), F.lit(";")).alias("drop_statement"),
            F.when(F.col("row_list").isNotNull(), F.lit("ROW")).when(F.col("page_list").isNotNull(), F.lit("PAGE")).otherwise(F.lit("")).alias("data_compression_desc"),
            "reserved_in_row_gb", "reserved_lob_gb", "row_count", "partition_count", "user_seeks", "user_scans", "user_lookups",
            F.col("user_updates").alias("queries_that_modified"), "is_unique", "is_disabled",
            "allow_page_locks", "allow_row_locks", "is_hypothetical",
            F.col("filter_definition").isNotNull().cast("int").alias("has_filter"), "fill_factor",
            estimate.alias("est_compression_savings"), compress.alias("compression_command"),
            "table_created_date", "table_modify_date",
            F.coalesce("partition_function", F.lit("/* Not partitioned */")).alias("partition_function"),
            F.coalesce("partition_scheme", "filegroup").alias("partition_scheme_or_filegroup"),
        )
    )


def nc_index_summary(indexes: DataFrame, table_columns: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Column and index counts per table that has nonclustered indexes.

    Table columns and index columns are counted apart and joined per table; the
    product of columns and indexes is never formed.  An index column counts when
    the table has it.
    """
    nc = indexes.where("type = 2 AND object_type = 'U'").select(*INDEX, "schema_name", "table_name", "index_name")
    names = nc.groupBy(*DB, "schema_name", "table_name", "object_id").agg(F.countDistinct("index_name").alias("index_count"))
    tables = table_columns.groupBy(*OBJECT).agg(F.countDistinct("column_name").alias("table_columns"))
    used = (
        index_columns.join(nc.select(*INDEX), INDEX, "left_semi")
        .join(table_columns.select(*OBJECT, "column_id"), [*OBJECT, "column_id"], "left_semi")
        .groupBy(*OBJECT).agg(
            F.count("column_id").alias("indexed_columns"),
            F.sum(F.when(F.col("is_included_column") == 0, 1).when(F.col("is_included_column") == 1, 0)).alias("key_columns"),
            F.sum(F.col("is_included_column").cast("bigint")).alias("included_columns"),
        )
    )
    return names.join(tables, OBJECT).join(used, OBJECT, "left").groupBy(*DB, "schema_name", "table_name").agg(
        F.max("table_columns").alias("table_columns"), F.sum("index_count").alias("index_count"),
        F.sum(F.coalesce("indexed_columns", F.lit(0).cast("bigint"))).alias("indexed_columns"),
        F.sum("key_columns").alias("key_columns"), F.sum("included_columns").alias("included_columns"),
    )


def heap_candidates(
    indexes: DataFrame, partitions: DataFrame, *, min_rows: int = 200_000, sample: int = 15, seed: int = 0
) -> DataFrame:
    """A repeatable random sample of the big heaps of each database, with their columnstore command.

    The order is a keyed hash, so the same seed gives the same heaps whatever the
    partitioning.  Tables only: views have no heap.
    """
    rows = partitions.where("index_id = 0").groupBy(*INDEX).agg(F.sum("row_count").alias("row_count"))
    pick = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in OBJECT]))
    command = F.concat(F.lit("CREATE CLUSTERED COLUMNSTORE INDEX [Idx_cci_"), F.col("table_name"), F.lit("] ON "), _three_part(), F.lit(";"))
    place = F.row_number().over(Window.partitionBy(*DB).orderBy("_pick", "table_name"))
    return (
        indexes.where("index_id = 0 AND object_type = 'U'").join(rows.where(F.col("row_count") >= min_rows), INDEX)
        .select(*DB, "schema_name", "table_name", "row_count", command.alias("command"), pick.alias("_pick"))
        .withColumn("_place", place).where(F.col("_place") <= sample).drop("_pick", "_place")
    )


def _fragmented(fragmentation: DataFrame, indexes: DataFrame, min_pct: float) -> DataFrame:
    tables = indexes.where("object_type = 'U'").select(*OBJECT, F.col("schema_name").alias("_ts"), F.col("table_name").alias("_tn")).distinct()
    views = indexes.where("object_type = 'V'").select(*OBJECT, F.col("schema_name").alias("_vs"), F.col("table_name").alias("_vn")).distinct()
    return (
        fragmentation.where((F.col("index_id") != 0) & (F.col("fragmentation_pct") >= min_pct))
        .join(tables, OBJECT, "left").join(views, OBJECT, "left")
        .join(indexes.select(*INDEX, "index_name"), INDEX, "left")
        .withColumns({
            "schema_name": F.coalesce("_ts", "_vs", F.lit("")), "table_name": F.coalesce("_tn", "_vn", F.lit("")),
            "index_name": F.coalesce("index_name", F.lit("")),
        })
    )


def fragmentation_actions(
    fragmentation: DataFrame, indexes: DataFrame, *, min_pct: float = 5.0, rebuild_above: float = 30.0, online: bool = True
) -> DataFrame:
    """REORGANIZE or REBUILD text for fragmented indexes outside read-only filegroups."""
    reorganize = F.col("fragmentation_pct") <= rebuild_above
    what = F.when(reorganize, F.lit("REORGANIZE")).otherwise(
        F.lit(f"REBUILD WITH (SORT_IN_TEMPDB = ON, ONLINE = {'ON' if online else 'OFF'})")
    )
    command = F.concat(F.lit("ALTER INDEX "), tx.quotename("index_name"), F.lit(" ON "), _three_part(), F.lit(" "), what)
    return _fragmented(fragmentation, indexes, min_pct).where("is_read_only = 0").select(
        *DB, "schema_name", "table_name", "index_name", "fragmentation_pct",
        F.when(reorganize, F.lit("REORGANIZE")).otherwise(F.lit("REBUILD")).alias("action"), command.alias("command"),
    )


def rebuild_history(
    fragmentation: DataFrame, indexes: DataFrame, *, rebuilt_at: Column, min_pct: float = 5.0, min_pages: int = 100, skip_read_only: bool = False
) -> DataFrame:
    """History rows of indexes with enough pages, to append.

    Read-only indexes, which were not touched, are recorded too unless skipped.
    """
    rows = _fragmented(fragmentation, indexes, min_pct).where(F.col("page_count") >= min_pages)
    if skip_read_only:
        rows = rows.where("is_read_only = 0")
    return rows.select(*DB, "schema_name", "table_name", "index_name", "fragmentation_pct", "page_count", rebuilt_at.alias("rebuild_date"))


def rowgroup_summary(rowgroups: DataFrame) -> DataFrame:
    """Row groups, rows and deleted rows per columnstore index and state."""
    return rowgroups.where(F.col("type_desc").like("%COLUMNSTORE%")).groupBy(
        *DB, "schema_name", "table_name", "index_name", "type_desc", "state_description"
    ).agg(F.count("*").alias("row_groups"), F.sum("total_rows").alias("total_rows"), F.sum("deleted_rows").alias("deleted_rows"))


def rowgroup_maintenance(
    rowgroups: DataFrame, *, deleted_rows: int = 5000, deleted_pct: int = 2, compress_all: bool = True
) -> DataFrame:
    """Per columnstore index the reorganize text, and the rebuild text where due.

    The limits apply to the sums of all compressed row groups of an index; an index
    without rows is judged by its deleted rows alone.
    """
    percent = int_div(F.col("deleted_rows") * 100, F.col("total_rows"))
    due = (F.col("state_description") == "COMPRESSED") & (
        (F.col("deleted_rows") >= deleted_rows) | F.coalesce(percent >= deleted_pct, F.lit(False))
    )
    alter = F.concat(F.lit("ALTER INDEX "), tx.quotename("index_name"), F.lit(" ON "), _three_part())
    switch = "ON" if compress_all else "OFF"
    return (
        rowgroup_summary(rowgroups)
        .groupBy(*DB, "schema_name", "table_name", "index_name").agg(F.max(due).alias("rebuild"))
        .select(
            *DB, "schema_name", "table_name", "index_name", "rebuild",
            F.concat(alter, F.lit(f" REORGANIZE WITH (COMPRESS_ALL_ROW_GROUPS = {switch});")).alias("reorganize_command"),
            F.when(F.col("rebuild"), F.concat(alter, F.lit(" REBUILD"))).alias("rebuild_command"),
        )
    )


def compression_candidates(
    indexes: DataFrame,
    partitions: DataFrame,
    *,
    compression_from: str,
    compression_to: str,
    schema: str | None = None,
    table: str | None = None,
    online: bool = True,
) -> DataFrame:
    """Rebuild text for every index partition with one compression, for another.

    With a table only its indexes; without one, all objects the vendor does not ship.
    """
    for kind in (compression_from, compression_to):
        if kind not in COMPRESSION:
            raise ValueError(f"compression {kind!r} is not one of {COMPRESSION}")
    if compression_from == compression_to:
        raise ValueError("compression types are equal, nothing to do")
    scope = indexes.where("is_ms_shipped = 0") if table is None else indexes.where(
        (F.col("table_name") == table) & (F.col("schema_name") == schema)
    )
    target = F.when(F.col("index_id") == 0, F.lit("ALTER TABLE ")).otherwise(
        F.concat(F.lit("ALTER INDEX "), tx.quotename("index_name"), F.lit(" ON "))
    )
    command = F.concat(
        F.lit("USE "), tx.quotename("database_name"), F.lit("; "), target, _two_part(),
        F.lit(f" REBUILD PARTITION = ALL WITH (DATA_COMPRESSION = {compression_to}, ONLINE = {'ON' if online else 'OFF'});"),
    )
    wanted = partitions.where(F.col("data_compression_desc") == compression_from).select(*INDEX, "partition_number")
    return scope.join(wanted, INDEX).select(*DB, "schema_name", "table_name", "index_name", "index_id", "partition_number", command.alias("command"))


def index_toggle_json(indexes: DataFrame, *, disabled: bool) -> DataFrame:
    """Nonclustered indexes of a table in one state, as a JSON array of names."""
    rows = indexes.where((F.col("type_desc") == "NONCLUSTERED") & (F.col("is_disabled") == int(disabled)))
    names = F.sort_array(F.collect_list(F.struct(F.col("index_name").alias("name"))))
    return rows.groupBy(*DB, "schema_name", "table_name").agg(F.to_json(names).alias("names"))


def index_toggle_commands(indexes: DataFrame, *, enable: bool) -> DataFrame:
    """Commands that enable the disabled indexes of each table, or disable the enabled."""
    listed = index_toggle_json(indexes, disabled=enable)
    each = F.explode(F.from_json("names", "array<struct<name:string>>"))
    action = "REBUILD" if enable else "DISABLE"
    return listed.select(*DB, "schema_name", "table_name", each.alias("j")).select(
        *DB, "schema_name", "table_name", F.col("j.name").alias("index_name"),
        F.concat(F.lit("ALTER INDEX "), tx.quotename(F.col("j.name")), F.lit(" ON "), _three_part(), F.lit(f" {action}; ")).alias("command"),
    )


def index_ddl_rewrite(ddl: DataFrame) -> DataFrame:
    """Index DDL with a compression option where it has none.

    Text without a WITH clause gets one; otherwise the option goes into the last
    WITH.  Statements with ROW or PAGE compression or a columnstore stay as they are.
    """
    text = F.col("command_text")
    done = (
        text.ilike(r"%WITH%(%DATA\_COMPRESSION%=%ROW%)%") | text.ilike(r"%WITH%(%DATA\_COMPRESSION%=%PAGE%)%")
        | text.ilike("%COLUMNSTORE%")
    )
    last_with = r"(?is)^(.*)\bWITH\s*\((?!.*\bWITH\s*\()(.*)$"
    inserted = F.regexp_replace(text, last_with, "$1WITH(DATA_COMPRESSION = ROW,$2")
    new = F.when(done, text).when(text.rlike(last_with), inserted).otherwise(F.concat(text, F.lit(" WITH(DATA_COMPRESSION = ROW)")))
    return ddl.select("server_name", "event_id", "command_text", new.alias("new_command"), (~done).alias("rewritten"))


def fragmented_catalogs(fragments: DataFrame) -> DataFrame:
    """Full-text catalogs with a table of more than one fragment."""
    return fragments.groupBy(*DB, "catalog_name", "table_id").count().where("count > 1").select(*DB, "catalog_name").distinct()


def tables_with_stats(statistics: DataFrame, databases: DataFrame) -> DataFrame:
    """Tables with statistics in online, writable, multi-user databases."""
    ready = databases.where(
        (F.col("user_access_desc") == "MULTI_USER") & (F.col("state_desc") == "ONLINE") & (F.col("is_read_only") == 0)
        & (F.col("is_in_standby") == 0) & ~F.col("database_name").isin("master", "tempdb", "model")
    )
    return statistics.select(*DB, "schema_name", "table_name").distinct().join(ready.select(*DB), DB, "left_semi")


def distribution_skew(
    compute: DataFrame,
    control: DataFrame,
    *,
    min_rows: int = 1_000_000,
    min_skew: float = 10,
    missing_rows: int = 1000,
    outdated_pct: float = 20,
) -> DataFrame:
    """Tables whose rows are spread unevenly or whose statistics are off."""
    key = ["server_name", "object_id", "index_id"]

    def percent(part: Column, whole: Column) -> Column:
        return part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0).cast("bigint")).cast("decimal(20,0)")

    per_distribution = compute.where("index_id < 2").groupBy(*key, "distribution_id").agg(F.sum("row_count").alias("n"))
    cmp = per_distribution.groupBy(*key).agg(
        F.sum("n").alias("cmp_row_count"), (F.max("n") - F.min("n")).alias("highest_skew_rows_difference")
    ).withColumn("skew_percent", percent(F.col("highest_skew_rows_difference"), F.col("cmp_row_count")).cast("decimal(10,2)"))
    ctl = control.where("index_id < 2").groupBy(*key, "schema_name", "table_name", "table_type", "distribution_type").agg(
        F.count("partition_number").alias("partitions"), F.sum("row_count").alias("ctl_row_count")
    )
    off = percent(F.abs(F.col("ctl_row_count") - F.col("cmp_row_count")), F.col("cmp_row_count"))
    stat = F.when(F.col("ctl_row_count") == missing_rows, F.lit("missing stats")).when(off > outdated_pct, F.lit("outdated stats"))
    skew = F.when(F.col("skew_percent") >= min_skew, F.lit("data skew"))
    return ctl.join(cmp, key).where(F.col("cmp_row_count") > min_rows).select(
        *key, "schema_name", "table_name", "table_type", "distribution_type", "partitions", "ctl_row_count", "cmp_row_count",
        off.cast("decimal(10,2)").alias("difference_percent"), "highest_skew_rows_difference", "skew_percent",
        stat.alias("stat_info"), skew.alias("skew_info"),
    ).where(F.col("stat_info").isNotNull() | F.col("skew_info").isNotNull())
