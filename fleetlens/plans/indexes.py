"""Index, storage and plan family."""

from __future__ import annotations

from fleetlens.operators import indexes as ix
from fleetlens.operators import queryplans as qp
from fleetlens.plans.backup import ts
from fleetlens.plans.registry import query

STATS_DATE = "2001-12-01 00:00:00"
STARTED = "2001-11-01 00:00:00"
_K = "USING (server_name, database_name, object_id, index_id)"


def _q(x: str) -> str:
    return f"('[' || replace({x}, ']', ']]') || ']')"


_TWO = f"{_q('schema_name')} || '.' || {_q('table_name')}"
_THREE = f"{_q('database_name')} || '.' || {_TWO}"


def _dec(num: str, den: str, scale: int, kind: str) -> str:
    """Exact half-up quotient as a decimal text."""
    p = 10 ** scale
    cell = f"((cast({num} AS hugeint) * {2 * p} + ({den})) // (2 * ({den})))"
    return f"cast(({cell} // {p}) || '.' || lpad(cast({cell} % {p} AS varchar), {scale}, '0') AS {kind})"


_USAGE = f"""
usage_report AS (SELECT i.server_name, i.database_name, i.schema_name, i.table_name, coalesce(i.index_name, '') AS index_name, i.index_id, i.type_desc, p.partition_number,
  cast(u.user_seeks AS bigint) AS user_seeks, cast(u.user_scans AS bigint) AS user_scans, cast(u.user_lookups AS bigint) AS user_lookups, u.user_updates, p.data_compression_desc, p.row_count,
  cast(p.used_page_count * 8 // 1024 AS bigint) AS size_mb, cast(p.in_row_page_count AS bigint) AS in_row_page_count, cast(p.overflow_page_count AS bigint) AS overflow_page_count, cast(p.lob_page_count AS bigint) AS lob_page_count,
  TIMESTAMP '{STATS_DATE}' AS stats_date
  FROM fx_index i JOIN fx_index_partition p {_K} LEFT JOIN fx_index_usage u {_K} WHERE i.object_type = 'U' AND p.row_count > 0 AND i.database_name NOT IN ('master', 'model', 'msdb', 'tempdb'))
"""


def _usage(t):
    return ix.index_usage_report(t("fx_index"), t("fx_index_partition"), t("fx_index_usage"), stats_date=ts(STATS_DATE))


@query("index_usage_report", f"WITH {_USAGE} SELECT * FROM usage_report")
def index_usage_report(t):
    return _usage(t)


_SECS = 30 * 86400
_RATES = ", ".join(
    f"{_dec(f'user_{k} * {m}', str(_SECS), 10, 'decimal(30,10)')} AS {k}_per_{u}" for k in ("seeks", "scans") for u, m in (("sec", 1), ("min", 60), ("hour", 3600))
)


@query("index_usage_rates", f"""
WITH {_USAGE} SELECT server_name, database_name, table_name, index_name, index_id, partition_number, {_RATES},
  'USE ' || {_q('database_name')} || '; EXEC sp_estimate_data_compression_savings ''' || schema_name || ''', ''' || table_name || ''', ' || index_id || ', NULL, ''ROW'';' AS estimate_command,
  'USE ' || {_q('database_name')} || '; ALTER ' || CASE WHEN index_id = 0 THEN 'TABLE ' ELSE 'INDEX ' || {_q('index_name')} || ' ON ' END || {_TWO} || ' REBUILD PARTITION = ALL WITH (DATA_COMPRESSION = ROW);' AS enable_command
FROM usage_report
""")
def index_usage_rates(t):
    return ix.index_usage_rates(_usage(t), started=ts(STARTED))


_G = "GROUP BY server_name, database_name, object_id, index_id"
_KEYS = "server_name, database_name, object_id, index_id"


@query("index_script_out", f"""
WITH lists AS (SELECT {_KEYS}, string_agg({_q('column_name')} || CASE WHEN is_descending_key = 1 THEN ' DESC' ELSE '' END, ', ' ORDER BY key_ordinal) FILTER (key_ordinal > 0) AS index_keys,
  string_agg({_q('column_name')}, ', ' ORDER BY column_name) FILTER (is_included_column = 1) AS include_keys, max({_q('column_name')}) FILTER (partition_ordinal = 1) AS partition_column FROM fx_index_column {_G}),
sums AS (SELECT {_KEYS}, count(*) AS partition_count, cast(sum(row_count) AS bigint) AS row_count, {_dec('sum(in_row_page_count) * 8', '1048576', 2, 'decimal(32,2)')} AS reserved_in_row_gb, {_dec('sum(lob_page_count) * 8', '1048576', 2, 'decimal(32,2)')} AS reserved_lob_gb,
  string_agg(cast(partition_number AS varchar), ', ' ORDER BY partition_number) FILTER (data_compression_desc = 'ROW') AS row_list, string_agg(cast(partition_number AS varchar), ', ' ORDER BY partition_number) FILTER (data_compression_desc = 'PAGE') AS page_list FROM fx_index_partition {_G}),
compressed AS (SELECT {_KEYS}, array_to_string(list_transform(list_filter([{{'kind': 'ROW', 'on': row_list}}, {{'kind': 'PAGE', 'on': page_list}}], lambda x: x.on IS NOT NULL), lambda x: 'DATA_COMPRESSION = ' || x.kind || ' ' || CASE WHEN partitioned THEN ' ON PARTITIONS (' || x.on || ')' ELSE '' END), ', ') AS options
  FROM (SELECT s.*, i.partition_scheme IS NOT NULL AS partitioned FROM sums s JOIN fx_index i {_K})),
j AS (SELECT i.*, l.index_keys, l.include_keys, l.partition_column, nullif(o.options, '') AS options, s.* EXCLUDE ({_KEYS}), u.* EXCLUDE ({_KEYS}) FROM fx_index i LEFT JOIN lists l {_K} LEFT JOIN sums s {_K} LEFT JOIN compressed o {_K} LEFT JOIN fx_index_usage u {_K} WHERE i.type IN (0, 1, 2, 5, 6) AND i.object_type = 'U'),
clauses AS (SELECT *, [
    CASE is_primary_key WHEN 1 THEN 'ALTER TABLE ' || {_TWO} || ' ADD CONSTRAINT ' || {_q('index_name')} || ' PRIMARY KEY' ELSE CASE is_unique WHEN 1 THEN 'CREATE UNIQUE' ELSE 'CREATE' END END,
    ' ' || CASE WHEN index_id > 1 THEN 'NONCLUSTERED ' ELSE 'CLUSTERED ' END, CASE is_primary_key WHEN 0 THEN 'INDEX ' || {_q('index_name')} || ' ON ' || {_TWO} || ' ' END,
    '(' || index_keys || ')', ' INCLUDE (' || include_keys || ')', ' WHERE ' || filter_definition, ' WITH (' || options || ')',
    ' ON ' || coalesce(partition_scheme || ' (' || partition_column || ')', {_q('filegroup')}, '') || ';'] AS parts FROM j)
SELECT server_name, database_name, schema_name || '.' || table_name AS table_name, index_id, index_name, greatest(last_user_seek, last_user_scan, last_user_lookup) AS last_user_read,
  last_user_seek, last_user_scan, last_user_lookup, last_user_update, index_keys, include_keys,
  CASE WHEN index_id = 0 THEN '/* No create statement (Heap) */' WHEN index_keys IS NOT NULL AND (partition_scheme IS NULL OR partition_column IS NOT NULL) THEN array_to_string(list_filter(parts, lambda x: x IS NOT NULL), '') END AS create_statement,
  'DROP INDEX ' || {_q('index_name')} || ' ON ' || {_TWO} || ';' AS drop_statement, CASE WHEN row_list IS NOT NULL THEN 'ROW' WHEN page_list IS NOT NULL THEN 'PAGE' ELSE '' END AS data_compression_desc,
  reserved_in_row_gb, reserved_lob_gb, row_count, partition_count, cast(user_seeks AS bigint) AS user_seeks, cast(user_scans AS bigint) AS user_scans, cast(user_lookups AS bigint) AS user_lookups, user_updates AS queries_that_modified,
  is_unique, is_disabled, allow_page_locks, allow_row_locks, is_hypothetical, cast(index_id = 3 AS int) AS has_filter, fill_factor,
  'USE ' || {_q('database_name')} || '; EXEC sp_estimate_data_compression_savings ''dbo'', ''' || table_name || ''', ' || index_id || ', NULL, ''ROW'';' AS est_compression_savings,
  'USE ' || {_q('database_name')} || '; ALTER ' || CASE WHEN index_id = 0 THEN 'TABLE ' ELSE 'INDEX ' || {_q('index_name')} || ' ON ' END || {_TWO} || ' REBUILD PARTITION = ALL WITH (DATA_COMPRESSION = ROW);' AS compression_command,
  table_created_date, table_modify_date, coalesce(partition_function, '/* Not partitioned */') AS partition_function, coalesce(partition_scheme, filegroup) AS partition_scheme_or_filegroup FROM clauses
""")
def index_script_out(t):
    return ix.index_script_out(t("fx_index"), t("fx_index_column"), t("fx_index_partition"), t("fx_index_usage"))


@query("nc_index_summary", """
SELECT i.server_name, i.database_name, i.schema_name, i.table_name, count(DISTINCT c.column_name) AS table_columns, count(DISTINCT i.index_name) AS index_count, count(ic.column_id) AS indexed_columns,
  cast(sum(1 - ic.is_included_column) AS bigint) AS key_columns, cast(sum(ic.is_included_column) AS bigint) AS included_columns
FROM fx_index i JOIN fx_table_column c ON c.server_name = i.server_name AND c.database_name = i.database_name AND c.object_id = i.object_id
LEFT JOIN fx_index_column ic ON ic.server_name = i.server_name AND ic.database_name = i.database_name AND ic.object_id = i.object_id AND ic.index_id = i.index_id AND ic.column_id = c.column_id
WHERE i.type = 2 AND i.object_type = 'U' GROUP BY 1, 2, 3, 4
""")
def nc_index_summary(t):
    return ix.nc_index_summary(t("fx_index"), t("fx_table_column"), t("fx_index_column"))


@query("heap_candidates", f"""
SELECT * EXCLUDE (place) FROM (SELECT server_name, database_name, schema_name, table_name, row_count, 'CREATE CLUSTERED COLUMNSTORE INDEX [Idx_cci_' || table_name || '] ON ' || {_THREE} || ';' AS command,
    row_number() OVER (PARTITION BY server_name, database_name ORDER BY md5('7|' || server_name || '|' || database_name || '|' || object_id), table_name) AS place
  FROM fx_index i JOIN (SELECT {_KEYS}, cast(sum(row_count) AS bigint) AS row_count FROM fx_index_partition WHERE index_id = 0 {_G}) p {_K} WHERE row_count >= 10 AND object_type = 'U')
WHERE place <= 2
""")
def heap_candidates(t):
    return ix.heap_candidates(t("fx_index"), t("fx_index_partition"), min_rows=10, sample=2, seed=7)


@query("fragmentation_actions", f"""
SELECT server_name, database_name, schema_name, table_name, index_name, fragmentation_pct, CASE WHEN fragmentation_pct <= 30 THEN 'REORGANIZE' ELSE 'REBUILD' END AS action,
  'ALTER INDEX ' || {_q('index_name')} || ' ON ' || {_THREE} || ' ' || CASE WHEN fragmentation_pct <= 30 THEN 'REORGANIZE' ELSE 'REBUILD WITH (SORT_IN_TEMPDB = ON, ONLINE = ON)' END AS command
FROM fx_fragmentation f JOIN fx_index i {_K} WHERE index_id <> 0 AND fragmentation_pct >= 5 AND is_read_only = 0
""")
def fragmentation_actions(t):
    return ix.fragmentation_actions(t("fx_fragmentation"), t("fx_index"))


@query("rebuild_history", f"""
SELECT server_name, database_name, schema_name, table_name, index_name, fragmentation_pct, cast(page_count AS bigint) AS page_count, TIMESTAMP '{STATS_DATE}' AS rebuild_date
FROM fx_fragmentation f JOIN fx_index i {_K} WHERE index_id <> 0 AND fragmentation_pct >= 5 AND page_count >= 100
""")
def rebuild_history(t):
    return ix.rebuild_history(t("fx_fragmentation"), t("fx_index"), rebuilt_at=ts(STATS_DATE))


@query("rowgroup_maintenance", f"""
WITH csi AS (SELECT server_name, database_name, schema_name, table_name, index_name, type_desc, state_description, sum(total_rows) AS total_rows, sum(deleted_rows) AS deleted_rows FROM fx_rowgroup WHERE type_desc LIKE '%COLUMNSTORE%' GROUP BY ALL),
due AS (SELECT server_name, database_name, schema_name, table_name, index_name, bool_or(state_description = 'COMPRESSED' AND (deleted_rows >= 5000 OR coalesce(deleted_rows * 100 // nullif(total_rows, 0) >= 2, false))) AS rebuild FROM csi GROUP BY ALL)
SELECT *, 'ALTER INDEX ' || {_q('index_name')} || ' ON ' || {_THREE} || ' REORGANIZE WITH (COMPRESS_ALL_ROW_GROUPS = ON);' AS reorganize_command, CASE WHEN rebuild THEN 'ALTER INDEX ' || {_q('index_name')} || ' ON ' || {_THREE} || ' REBUILD' END AS rebuild_command FROM due
""")
def rowgroup_maintenance(t):
    return ix.rowgroup_maintenance(t("fx_rowgroup"))


@query("compression_candidates", f"""
SELECT server_name, database_name, schema_name, table_name, index_name, index_id, partition_number,
  'USE ' || {_q('database_name')} || '; ' || CASE WHEN index_id = 0 THEN 'ALTER TABLE ' ELSE 'ALTER INDEX ' || {_q('index_name')} || ' ON ' END || {_TWO} || ' REBUILD PARTITION = ALL WITH (DATA_COMPRESSION = PAGE, ONLINE = ON);' AS command
FROM fx_index i JOIN fx_index_partition p {_K} WHERE is_ms_shipped = 0 AND data_compression_desc = 'NONE'
""")
def compression_candidates(t):
    return ix.compression_candidates(t("fx_index"), t("fx_index_partition"), compression_from="NONE", compression_to="PAGE")


@query("index_toggle_commands", f"""
SELECT server_name, database_name, schema_name, table_name, index_name, 'ALTER INDEX ' || {_q('index_name')} || ' ON ' || {_THREE} || ' DISABLE; ' AS command FROM fx_index WHERE type_desc = 'NONCLUSTERED' AND is_disabled = 0
""")
def index_toggle_commands(t):
    return ix.index_toggle_commands(t("fx_index"), enable=False)


@query("index_enable_commands", f"""
SELECT server_name, database_name, schema_name, table_name, index_name, 'ALTER INDEX ' || {_q('index_name')} || ' ON ' || {_THREE} || ' REBUILD; ' AS command FROM fx_index WHERE type_desc = 'NONCLUSTERED' AND is_disabled = 1
""")
def index_enable_commands(t):
    return ix.index_toggle_commands(t("fx_index"), enable=True)


@query("index_ddl_rewrite", """
SELECT server_name, event_id, command_text, CASE event_id % 5 WHEN 0 THEN command_text || ' WITH(DATA_COMPRESSION = ROW)' WHEN 1 THEN replace(command_text, 'WITH (', 'WITH(DATA_COMPRESSION = ROW,') WHEN 4 THEN replace(command_text, 'with (', 'WITH(DATA_COMPRESSION = ROW,') ELSE command_text END AS new_command,
  event_id % 5 IN (0, 1, 4) AS rewritten FROM fx_ddl_log
""")
def index_ddl_rewrite(t):
    return ix.index_ddl_rewrite(t("fx_ddl_log"))


@query("fragmented_catalogs", """
SELECT DISTINCT server_name, database_name, catalog_name FROM (SELECT server_name, database_name, catalog_name, table_id, count(*) AS n FROM fx_fulltext_fragment GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
""")
def fragmented_catalogs(t):
    return ix.fragmented_catalogs(t("fx_fulltext_fragment"))


@query("tables_with_stats", """
SELECT DISTINCT s.server_name, s.database_name, s.schema_name, s.table_name FROM fx_statistics s JOIN fx_databases d ON d.server_name = s.server_name AND d.database_name = s.database_name
WHERE d.user_access_desc = 'MULTI_USER' AND d.state_desc = 'ONLINE' AND d.is_read_only = 0 AND d.is_in_standby = 0 AND d.database_name NOT IN ('master', 'tempdb', 'model')
""")
def tables_with_stats(t):
    return ix.tables_with_stats(t("fx_statistics"), t("fx_databases"))


@query("missing_index_plans", f"""
WITH costly AS (SELECT server_name, database_name, plan_id, cast(sum(count_executions) AS bigint) AS count_executions, sum(cast(count_executions AS hugeint) * avg_duration_us) AS d, sum(cast(count_executions AS hugeint) * avg_cpu_us) AS c
  FROM fx_runtime_stats WHERE last_execution_time > TIMESTAMP '2001-06-01 00:00:00' - INTERVAL '720' HOUR GROUP BY 1, 2, 3 HAVING sum(cast(count_executions AS hugeint) * avg_cpu_us) >= 999995),
stmt AS (SELECT p.server_name, p.database_name, p.plan_id, p.query_id, k.p_brand, k.p_size, unnest(list_concat([1], CASE WHEN k.p_size % 3 = 0 THEN [2] ELSE [] END, CASE WHEN k.p_partkey % 5 = 0 THEN [3] ELSE [] END)) AS n FROM fx_plan p JOIN part k ON k.p_partkey = p.plan_id WHERE p.plan_id % 13 <> 0 AND k.p_size % 2 = 0)
SELECT s.server_name, s.database_name, s.plan_id, s.query_id, q.object_name, q.query_sql_text, CASE WHEN n = 1 THEN '[d]' END AS missing_database, CASE WHEN n = 1 THEN '[dbo]' END AS missing_schema, CASE WHEN n = 1 THEN '[' || s.p_brand || ' & co]' END AS missing_table,
  CASE WHEN n = 1 THEN cast(s.p_size AS double) + 0.5 END AS impact, c.count_executions, {_dec('c.d', '1000', 2, 'decimal(20,2)')} AS total_duration_ms, {_dec('c.c', '1000', 2, 'decimal(20,2)')} AS total_cpu_time_ms
FROM costly c JOIN stmt s ON s.server_name = c.server_name AND s.database_name = c.database_name AND s.plan_id = c.plan_id JOIN fx_query_text q ON q.server_name = s.server_name AND q.database_name = s.database_name AND q.query_id = s.query_id
""")
def missing_index_plans(t):
    found = qp.missing_index_plans(
        t("fx_runtime_stats"), t("fx_plan"), t("fx_query_text"), now=ts("2001-06-01 00:00:00"), hours=720, min_cpu_ms=1000
    )
    return found.orderBy("total_cpu_time_ms", ascending=False)


@query("distribution_skew", f"""
WITH d AS (SELECT server_name, object_id, index_id, distribution_id, cast(sum(row_count) AS bigint) AS n FROM fx_distribution WHERE index_id < 2 GROUP BY 1, 2, 3, 4),
cmp AS (SELECT server_name, object_id, index_id, cast(sum(n) AS bigint) AS cmp_row_count, max(n) - min(n) AS diff FROM d GROUP BY 1, 2, 3),
ctl AS (SELECT server_name, object_id, index_id, schema_name, table_name, table_type, distribution_type, count(partition_number) AS partitions, cast(sum(row_count) AS bigint) AS ctl_row_count FROM fx_control GROUP BY ALL),
j AS (SELECT ctl.*, cmp_row_count, {_dec('abs(ctl_row_count - cmp_row_count) * 100', 'cmp_row_count', 2, 'decimal(10,2)')} AS difference_percent, diff AS highest_skew_rows_difference, {_dec('diff * 100', 'cmp_row_count', 2, 'decimal(10,2)')} AS skew_percent,
  CASE WHEN ctl_row_count = 1000 THEN 'missing stats' WHEN abs(ctl_row_count - cmp_row_count) * 100 > 20 * cmp_row_count THEN 'outdated stats' END AS stat_info FROM ctl JOIN cmp USING (server_name, object_id, index_id) WHERE cmp_row_count > 100),
k AS (SELECT *, CASE WHEN skew_percent >= 5 THEN 'data skew' END AS skew_info FROM j)
SELECT * FROM k WHERE stat_info IS NOT NULL OR skew_info IS NOT NULL
""")
def distribution_skew(t):
    return ix.distribution_skew(t("fx_distribution"), t("fx_control"), min_rows=100, min_skew=5)
