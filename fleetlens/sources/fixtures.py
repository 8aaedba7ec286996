"""Operator inputs derived from the driver tables.

Each view is one SELECT that Spark and DuckDB both run, so that an operator and
its check read the same input.  ``{name}`` stands for a driver table or another
view.  Every view reads its source tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetlens.sources.tables import read_table, spread_small_scan

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# --- backup history -------------------------------------------------------

_DB_NAME = (
    "CASE {k} WHEN 0 THEN 'msdb' WHEN 1 THEN 'master' WHEN 2 THEN 'tempdb' WHEN 3 THEN 'model' "
    "ELSE concat('db', cast({k} AS varchar(10))) END"
)


def _db(k: str) -> str:
    return _DB_NAME.replace("{k}", k)


VIEWS["fx_backupset"] = f"""
SELECT concat('srv', cast(o_orderkey % 3 AS varchar(10))) AS server_name,
  o_orderkey AS backup_set_id, o_orderkey AS media_set_id,
  {_db('o_custkey % 52')} AS database_name,
  cast(o_orderkey % 3 * 100 + o_custkey % 52 AS int) AS database_guid,
  CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS type,
  o_orderdate AS backup_start_date,
  o_orderdate + INTERVAL '1' SECOND * cast(o_orderkey % 86400 AS int) AS backup_finish_date,
  CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_copy_only,
  CASE WHEN o_custkey % 5 = 0 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model,
  cast((year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) AS bigint) * 100000 AS first_lsn,
  cast((year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)) AS bigint) * 100000 + o_orderkey % 86400 AS last_lsn,
  cast(floor(o_totalprice * 100000) AS bigint) AS backup_size,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(floor(o_totalprice * 25000) AS bigint) END AS compressed_backup_size,
  CASE o_orderkey % 29 WHEN 0 THEN 'ARCHIVE' WHEN 1 THEN 'nightly' ELSE NULL END AS name,
  concat('user', cast(o_custkey % 7 AS varchar(10))) AS user_name
FROM {{orders}}
"""

VIEWS["fx_mediafamily"] = """
SELECT concat('srv', cast(l_orderkey % 3 AS varchar(10))) AS server_name,
  l_orderkey AS media_set_id, l_linenumber AS family_sequence_number,
  CASE WHEN min(l_partkey) % 10 = 0 THEN 7 ELSE 2 END AS device_type,
  cast(min(l_suppkey) % 2 AS int) AS mirror,
  concat('E:', chr(92), 'bak', chr(92), cast(l_orderkey AS varchar(20)), '_', cast(l_linenumber AS varchar(10)), '.bak') AS physical_device_name
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

VIEWS["fx_backupfile"] = """
SELECT concat('srv', cast(l_orderkey % 3 AS varchar(10))) AS server_name,
  l_orderkey AS backup_set_id, concat('f', cast(l_linenumber AS varchar(10))) AS logical_name,
  CASE WHEN l_linenumber % 3 = 0 THEN 'L' WHEN l_linenumber = 7 THEN 'F' ELSE 'D' END AS file_type,
  concat('C:', chr(92), 'data', chr(92), 'f', cast(l_orderkey AS varchar(20)), '_', cast(l_linenumber AS varchar(10)), '.mdf') AS physical_name
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""

# 150 databases on three servers; the history also knows databases that are gone
VIEWS["fx_databases"] = f"""
SELECT concat('srv', cast(k % 3 AS varchar(10))) AS server_name, {_db('k % 50')} AS database_name,
  cast(k % 3 * 100 + k % 50 AS int) AS database_guid,
  CASE WHEN k % 19 = 7 THEN 'OFFLINE' WHEN k % 11 = 2 THEN 'RESTORING' ELSE 'ONLINE' END AS state_desc,
  CASE WHEN k % 5 = 0 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model_desc,
  CASE WHEN k % 8 = 7 THEN 1 ELSE 0 END AS is_read_only,
  CASE WHEN k % 31 = 5 THEN 1 ELSE 0 END AS is_in_standby,
  CASE WHEN k % 11 = 10 THEN cast(k % 3 * 100 + (k + 30) % 50 AS int) ELSE NULL END AS source_database_guid,
  CASE WHEN k % 13 = 4 THEN 'SINGLE_USER' ELSE 'MULTI_USER' END AS user_access_desc,
  CASE WHEN k % 7 = 3 THEN 'TORN_PAGE_DETECTION' ELSE 'CHECKSUM' END AS page_verify_option_desc,
  CASE WHEN k % 6 = 1 THEN NULL ELSE cast(k AS bigint) * 1000 END AS last_log_backup_lsn,
  cast(k % 4 AS bigint) AS owner_sid
FROM (SELECT DISTINCT c_custkey % 150 AS k FROM {{customer}}) keys
"""

VIEWS["fx_restore_request"] = f"""
SELECT concat('srv', cast(k % 3 AS varchar(10))) AS server_name, {_db('k % 52')} AS database_name,
  TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '1' DAY * cast(k * 15 AS int) AS as_of
FROM (SELECT DISTINCT o_custkey % 156 AS k FROM {{orders}}) keys
"""

VIEWS["fx_allocation"] = f"""
SELECT concat('srv', cast(l_orderkey % 3 AS varchar(10))) AS server_name,
  {_db('l_partkey % 52')} AS database_name, l_suppkey AS container_id,
  cast(l_quantity AS bigint) * 5000 AS total_pages
FROM {{lineitem}}
"""

VIEWS["fx_file_listing"] = """
SELECT concat('srv', cast(l_orderkey % 3 AS varchar(10))) AS server_name,
  concat('E:', chr(92), 'bak', chr(92), cast(l_orderkey AS varchar(20)), '_', cast(l_linenumber AS varchar(10)), '.bak') AS path
FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING sum(l_quantity) > 5
"""

# --- blocking -------------------------------------------------------------

VIEWS["fx_blocked"] = """
SELECT concat('srv', cast(cast(floor(event_id / 20) AS bigint) % 3 AS varchar(10))) AS server_name,
  event_id AS blocked_process_id, ts AS post_time, cast(floor(event_id / 20) AS bigint) AS monitor_loop,
  least(user_id, cast(regexp_extract(props, '[0-9]+', 0) AS bigint)) AS blk_spid,
  greatest(user_id, cast(regexp_extract(props, '[0-9]+', 0) AS bigint)) AS vic_spid,
  cast(floor(value * 1000) AS bigint) AS duration_us
FROM {events}
"""

VIEWS["fx_blocked_xml"] = """
SELECT server_name, blocked_process_id, post_time, duration_us,
  cast(blocked_process_id % 3 * 100 + blocked_process_id % 50 AS int) AS database_id,
  cast(blocked_process_id % 4 AS int) AS index_id, blocked_process_id % 9 = 0 AS is_system,
  concat('dom', chr(92), 'u', cast(vic_spid AS varchar(20))) AS session_login_name,
  concat('<TextData><blocked-process-report monitorLoop="', cast(monitor_loop AS varchar(20)),
    '"><blocked-process><process taskpriority="', cast(vic_spid % 3 AS varchar(20)), '" logused="', cast(duration_us % 997 AS varchar(20)),
    '" waitresource="KEY: 5:', cast(monitor_loop AS varchar(20)), ' (8194443284a0)" waittime="', cast(duration_us AS varchar(20)),
    '" transactionname="user_transaction" lasttranstarted="', cast(cast(post_time AS date) AS varchar(10)), 'T01:02:03.120" XDES="0x', cast(vic_spid AS varchar(20)),
    '" lockMode="X" status="suspended" spid="', cast(vic_spid AS varchar(20)), '" ecid="0" priority="0" trancount="2" lastbatchstarted="',
    cast(cast(post_time AS date) AS varchar(10)), 'T04:05:06" clientapp="app &amp; co" hostname="h', cast(vic_spid % 5 AS varchar(20)), '" loginname="u', cast(vic_spid AS varchar(20)),
    '" isolationlevel="read committed (2)" currentdb="5"><inputbuf>SELECT 1 &lt; 2 </inputbuf></process></blocked-process>',
    '<blocking-process><process status="sleeping" spid="', cast(blk_spid AS varchar(20)), '" ecid="0" trancount="1" lastbatchcompleted="',
    cast(cast(post_time AS date) AS varchar(10)), 'T00:00:01" clientapp="job" hostname="h', cast(blk_spid % 5 AS varchar(20)), '" hostpid="', cast(blk_spid * 7 AS varchar(20)),
    '" loginname="u', cast(blk_spid AS varchar(20)), '" currentdb="6" lockTimeout="4294967295"><inputbuf>x</inputbuf></process></blocking-process></blocked-process-report></TextData>') AS text_data
FROM {fx_blocked}
"""

# --- event files ----------------------------------------------------------

VIEWS["fx_error_xml"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts, 'error_reported' AS object_name,
  concat('<event name="error_reported" timestamp="', cast(cast(ts AS date) AS varchar(10)), 'T00:00:00Z">',
    '<data name="error_number"><value>', cast(18400 + event_id % 100 AS varchar(10)), '</value></data>',
    '<data name="severity"><value>', cast(8 + event_id % 16 AS varchar(10)), '</value></data>',
    '<data name="state"><value>1</value></data>',
    '<data name="user_defined"><value>', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '</value></data>',
    '<data name="category"><value>2</value><text>', event_type, '</text></data>',
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('<data name="message"><value>k &amp; v', chr(10), cast(user_id AS varchar(10)), '</value></data>') END,
    '<action name="session_id"><value>', cast(user_id AS varchar(10)), '</value></action>',
    '<action name="database_name"><value>db', cast(event_id % 50 AS varchar(10)), '</value></action>',
    '<action name="username"><value>u', cast(user_id AS varchar(10)), '</value></action></event>') AS event_data
FROM {events}
"""

# ring buffers of twenty events each, one document per session and slot
VIEWS["fx_ring_xml"] = """
SELECT concat('srv', cast(slot % 3 AS varchar(10))) AS server_name, slot,
  concat('<RingBufferTarget totalEventsProcessed="', cast(count(*) AS varchar(10)), '">', string_agg(event_data, ''), '</RingBufferTarget>') AS target_data
FROM (SELECT cast(floor(event_id / 20) AS bigint) AS slot, event_data FROM {fx_error_xml}) docs
GROUP BY slot
"""

VIEWS["fx_statement"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts,
  CASE WHEN event_id % 10 = 9 THEN 'cursor_execute' ELSE CASE event_type WHEN 'view' THEN 'sql_statement_completed' WHEN 'signup' THEN 'rpc_completed'
    WHEN 'click' THEN 'sp_statement_completed' WHEN 'error' THEN 'error_reported' ELSE 'module_end' END END AS name,
  cast(floor(value * 1000) AS bigint) AS duration_us,
  cast(8 + event_id % 16 AS int) AS severity, cast(18400 + event_id % 100 AS int) AS error_number,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('m', cast(user_id AS varchar(10))) END AS message,
  user_id AS session_id, concat('app', cast(user_id % 5 AS varchar(10))) AS client_app_name,
  concat('host', cast(user_id % 9 AS varchar(10))) AS client_hostname, concat('db', cast(event_id % 50 AS varchar(10))) AS database_name,
  concat('u', cast(user_id AS varchar(10))) AS server_principal_name, props AS sql_text
FROM {events}
"""

VIEWS["fx_deadlock_xml"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts, 'xml_deadlock_report' AS object_name,
  concat('<event name="xml_deadlock_report" timestamp="', cast(cast(ts AS date) AS varchar(10)), 'T0', cast(event_id % 10 AS varchar(10)), ':30:00Z"><data name="xml_report"><value><deadlock><process-list>',
    '<process spid="', cast(user_id AS varchar(10)), '" clientapp="app" hostname="h1" loginname="u1"><inputbuf>a &lt; b</inputbuf></process>',
    CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('<process spid="', cast(user_id + 1000 AS varchar(10)), '" loginname="u2"><inputbuf>b</inputbuf></process>') END,
    '</process-list></deadlock></value></data></event>') AS event_data
FROM {events}
"""

# --- server and DDL events ------------------------------------------------

VIEWS["fx_server_event"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts AS post_time,
  CASE event_type
    WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'ADD_ROLE_MEMBER' WHEN 1 THEN 'ADD_SERVER_ROLE_MEMBER' WHEN 2 THEN 'CREATE_LOGIN' ELSE 'GRANT_DATABASE' END
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'AUDIT_DBCC_EVENT' WHEN 1 THEN 'DEADLOCK_GRAPH' WHEN 2 THEN 'DEPRECATION_ANNOUNCEMENT' ELSE 'DEPRECATION_FINAL_SUPPORT' END
    WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'ALTER_DATABASE' WHEN 1 THEN 'DROP_DATABASE' WHEN 2 THEN 'CREATE_DATABASE' WHEN 3 THEN 'ALTER_INSTANCE' ELSE 'ALTER_DATABASE' END
    WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'AUDIT_LOGIN' WHEN 1 THEN 'AUDIT_BACKUP_RESTORE_EVENT' WHEN 2 THEN 'AUDIT_CHANGE_DATABASE_OWNER' ELSE 'AUDIT_LOGIN_FAILED' END
    ELSE CASE event_id % 6 WHEN 0 THEN 'ALTER_INDEX' WHEN 1 THEN 'CREATE_INDEX' WHEN 2 THEN 'DATA_FILE_AUTO_GROW' WHEN 3 THEN 'LOG_FILE_AUTO_GROW' WHEN 4 THEN 'UPDATE_STATISTICS' ELSE 'ALTER_QUEUE' END
  END AS event_type,
  CASE user_id % 6 WHEN 0 THEN 'SA' WHEN 1 THEN concat('dom', chr(92), 'DBA') WHEN 2 THEN NULL ELSE concat('u', cast(user_id AS varchar(10))) END AS login_name,
  CASE event_id % 7 WHEN 0 THEN 'msdb' WHEN 1 THEN 'SSISDB' WHEN 2 THEN NULL ELSE concat('db', cast(event_id % 60 AS varchar(10))) END AS database_name,
  CASE WHEN event_id % 2 = 0 THEN 'dbo' ELSE '' END AS schema_name,
  CASE event_id % 9 WHEN 0 THEN 'RSExecRole' WHEN 1 THEN 'SchemaCreator' ELSE concat('obj', cast(event_id % 40 AS varchar(10))) END AS object_name,
  CASE event_id % 8 WHEN 0 THEN 'Server' ELSE 'Table' END AS target_object_type,
  CASE event_id % 3 WHEN 0 THEN 'db_owner' WHEN 1 THEN 'db_datareader' ELSE 'sysadmin' END AS role_name,
  CASE event_id % 5 WHEN 0 THEN concat('ALTER DATABASE x ', CASE cast(floor(event_id / 5) AS bigint) % 8 WHEN 0 THEN 'SET RECOVERY SIMPLE' WHEN 1 THEN 'MODIFY FILE (NAME = f)' WHEN 2 THEN 'SET PAGE_VERIFY NONE' WHEN 3 THEN 'SET AUTO_SHRINK ON'
      WHEN 4 THEN 'set auto_close on' WHEN 5 THEN 'SET AUTO_UPDATE_STATISTICS OFF' WHEN 6 THEN 'SET AUTO_CREATE_STATISTICS OFF' ELSE 'SET READ_ONLY' END) WHEN 1 THEN 'ALTER INDEX i ON t REBUILD' WHEN 2 THEN 'dbcc show_statistics'
    WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'RESTORE DATABASE x WITH NORECOVERY' ELSE 'restore database x' END
    ELSE 'CREATE INDEX i ON t(a) WITH (PAD_INDEX = OFF)' END AS command_text,
  cast(cast(floor(event_id / 4) AS bigint) % 2 AS int) AS success, CASE WHEN event_id % 7 = 6 THEN 1 ELSE 0 END AS is_system, cast(1 + event_id % 3 AS int) AS event_subclass
FROM {events}
"""

# restores and state snapshots of 150 databases, from the event rows
VIEWS["fx_restore_event"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, concat('db', cast(user_id % 50 AS varchar(10))) AS database_name, event_id, ts AS post_time, false AS corrupt,
  CASE WHEN event_id % 28 = 1 THEN 'AUDIT_LOGIN' ELSE 'AUDIT_BACKUP_RESTORE_EVENT' END AS event_type, cast(CASE WHEN event_id % 20 = 5 THEN 1 ELSE 2 END AS int) AS event_subclass,
  CASE WHEN event_id % 12 = 9 THEN 'RESTORE DATABASE x WITH NORECOVERY' ELSE 'restore database x' END AS command_text
FROM {events} WHERE event_id % 4 = 1
"""

VIEWS["fx_database_state"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, concat('db', cast(user_id % 50 AS varchar(10))) AS database_name, date_trunc('minute', ts) AS snapshot_time,
  CASE cast(floor(event_id / 4) AS bigint) % 9 WHEN 0 THEN 'ONLINE' WHEN 1 THEN 'OFFLINE' WHEN 2 THEN 'SUSPECT' WHEN 3 THEN '' WHEN 4 THEN 'RECOVERING' ELSE 'RESTORING' END AS state_desc
FROM {events} WHERE event_id % 4 <> 1
"""

VIEWS["fx_server_event_xml"] = """
SELECT server_name, event_id, post_time,
  CASE WHEN event_id % 97 = 13 THEN '<EVENT_INSTANCE><EventType>BROKEN' ELSE
  concat('<EVENT_INSTANCE><EventType>', event_type, '</EventType><PostTime>', replace(cast(post_time AS varchar(30)), ' ', 'T'), '</PostTime>',
    CASE WHEN event_id % 4 = 1 THEN concat('<SPID>', cast(event_id % 90 AS varchar(10)), '</SPID>') ELSE '' END,
    CASE WHEN event_id % 4 <> 2 THEN concat('<ServerName>', server_name, '</ServerName>') ELSE '' END,
    CASE WHEN login_name IS NULL THEN '' ELSE concat('<LoginName>', login_name, '</LoginName>') END,
    CASE WHEN event_id % 4 = 2 THEN concat('<ServerName>', server_name, '</ServerName>') ELSE '' END,
    CASE WHEN database_name IS NULL THEN '' ELSE concat('<DatabaseName>', database_name, '</DatabaseName>') END,
    '<SchemaName>', schema_name, '</SchemaName><ObjectName>', object_name, '</ObjectName><TargetObjectType>', target_object_type, '</TargetObjectType><RoleName>', role_name,
    '</RoleName><TextData>', command_text, '</TextData><EventSubClass>', cast(event_subclass AS varchar(10)), '</EventSubClass><Success>', cast(success AS varchar(10)),
    '</Success><IsSystem>', cast(is_system AS varchar(10)), '</IsSystem>', CASE WHEN event_id % 3 = 0 THEN '<HostName>h &amp; <b>1</b></HostName><Empty/>' ELSE '' END,
    '<TSQLCommand><SetOptions ANSI_NULLS="ON"/><CommandText>', command_text, '</CommandText></TSQLCommand></EVENT_INSTANCE>') END AS message_body
FROM {fx_server_event}
"""

VIEWS["fx_shipped_object"] = """
SELECT DISTINCT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_orderkey % 60 AS varchar(10))) AS database_name,
  'dbo' AS schema_name, concat('obj', cast(l_partkey % 40 AS varchar(10))) AS object_name,
  CASE WHEN (l_orderkey % 60 + l_partkey % 40) % 6 = 0 THEN 1 ELSE 0 END AS is_ms_shipped
FROM {lineitem}
"""

VIEWS["fx_ddl_log"] = """
SELECT server_name, event_id, post_time,
  CASE event_id % 5 WHEN 0 THEN concat('CREATE INDEX [ix', cast(event_id AS varchar(10)), '] ON [dbo].[t]([a], [b])')
    WHEN 1 THEN concat('CREATE INDEX [ix', cast(event_id AS varchar(10)), '] ON [dbo].[t]([a]) WITH (PAD_INDEX = OFF, ONLINE = OFF)')
    WHEN 2 THEN 'CREATE INDEX i ON t(a) WITH (DATA_COMPRESSION = PAGE)' WHEN 3 THEN 'create clustered columnstore index cci on t'
    ELSE concat('CREATE INDEX [with', cast(event_id AS varchar(10)), '] ON t(a) with ( FILLFACTOR = 90 )') END AS command_text
FROM {fx_server_event}
"""

# --- alerts, drives, counters ---------------------------------------------

VIEWS["fx_alert_event"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts, cast(10 + event_id % 16 AS int) AS severity,
  CASE event_id % 23 WHEN 0 THEN 823 WHEN 1 THEN 824 WHEN 2 THEN 18456 ELSE cast(event_id % 500 AS int) END AS error_number,
  CASE event_id % 19 WHEN 0 THEN 'DATA_FILE_AUTO_GROW' WHEN 1 THEN 'LOG_FILE_AUTO_GROW' WHEN 2 THEN 'BLOCKED_PROCESS_REPORT' ELSE NULL END AS event_class,
  CASE WHEN event_id % 46 = 2 THEN 'Login failed for user ''sa''. Reason: Password did not match that for the login provided.' WHEN event_id % 5 = 0 THEN 'x CLIENT: 10.0.42.20' ELSE 'other' END AS description
FROM {events}
"""

VIEWS["fx_drive_sample"] = """
SELECT concat('srv', cast(user_id % 3 AS varchar(10))) AS server_name, date_trunc('hour', ts) AS sample_time, chr(cast(67 + user_id % 4 AS int)) AS drive,
  cast(floor(min(value) / 20) * 400 AS int) AS mb_free, 4096 AS mb_total
FROM {events} GROUP BY user_id % 3, date_trunc('hour', ts), user_id % 4
"""

VIEWS["fx_volume"] = """
SELECT concat('srv', cast(user_id % 3 AS varchar(10))) AS server_name, event_id, concat(chr(cast(67 + event_id % 9 AS int)), ':', chr(92)) AS volume_mount_point,
  cast(40 + event_id % 9 * 20 AS bigint) * 1073741824 AS total_bytes, cast(user_id % 9 + event_id % 9 * 3 AS bigint) * 1073741000 AS available_bytes
FROM {events}
"""

VIEWS["fx_counter"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name, event_id, ts, cast(event_id * 100 AS bigint) AS pages_read_since_startup,
  CASE event_id % 3 WHEN 0 THEN 'Page reads/sec' WHEN 1 THEN 'Page writes/sec' ELSE 'Page reads/sec' END AS counter_name,
  CASE event_id % 4 WHEN 3 THEN 'Plan Cache' ELSE 'SRV:Buffer Manager' END AS counter_object,
  TIMESTAMP '2023-12-31 00:00:00' + INTERVAL '1' DAY * cast(floor(event_id / 2000) AS int) AS start_time,
  CASE event_id % 4 WHEN 0 THEN 'SLEEP_TASK' WHEN 1 THEN 'WAITFOR' WHEN 2 THEN 'PAGEIOLATCH_SH' ELSE 'CXPACKET' END AS wait_type, cast(floor(value) AS bigint) AS wait_ms
FROM {events}
"""

VIEWS["fx_service_login"] = """
SELECT c_custkey AS server_id, CASE c_custkey % 3 WHEN 0 THEN concat('DOM', chr(92), 'Engine') WHEN 1 THEN 'engine@corp.example' ELSE c_name END AS engine_login,
  CASE c_custkey % 4 WHEN 0 THEN concat('dom', chr(92), 'agent') WHEN 1 THEN NULL WHEN 2 THEN '' ELSE c_mktsegment END AS agent_login
FROM {customer}
"""

# --- indexes, storage, plans ----------------------------------------------

VIEWS["fx_index"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_linenumber - 1 AS int) AS index_id, 'dbo' AS schema_name, concat('t', cast(l_suppkey AS varchar(10))) AS table_name,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('ix', cast(l_linenumber AS varchar(10)), CASE WHEN l_linenumber = 6 THEN ']' ELSE '' END) END AS index_name,
  CASE l_linenumber WHEN 1 THEN 'HEAP' WHEN 2 THEN 'CLUSTERED' WHEN 7 THEN 'NONCLUSTERED COLUMNSTORE' ELSE 'NONCLUSTERED' END AS type_desc,
  CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 7 THEN 6 ELSE 2 END AS type,
  CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS is_primary_key, CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS is_unique,
  CASE WHEN (l_suppkey + l_linenumber) % 4 = 0 THEN 1 ELSE 0 END AS is_disabled,
  CASE WHEN l_linenumber = 4 THEN '([c1]>(0))' ELSE NULL END AS filter_definition,
  CASE WHEN l_suppkey % 5 = 0 THEN 'ps_month' ELSE NULL END AS partition_scheme, CASE WHEN l_suppkey % 5 = 0 THEN 'pf_month' ELSE NULL END AS partition_function,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'PRIMARY' END AS filegroup,
  CASE WHEN l_suppkey % 9 = 0 THEN 'V' ELSE 'U' END AS object_type, CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END AS is_ms_shipped,
  CASE WHEN l_suppkey % 4 = 1 THEN 0 ELSE 1 END AS allow_page_locks, CASE WHEN l_linenumber = 5 THEN 0 ELSE 1 END AS allow_row_locks,
  CASE WHEN l_suppkey % 19 = 7 AND l_linenumber = 4 THEN 1 ELSE 0 END AS is_hypothetical, cast(l_suppkey % 3 * 40 AS int) AS fill_factor,
  min(l_shipdate) AS table_created_date, max(l_shipdate) AS table_modify_date
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""

VIEWS["fx_index_partition"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_linenumber - 1 AS int) AS index_id, cast(1 + l_orderkey % 3 AS int) AS partition_number,
  CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN CASE l_orderkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ROW' ELSE 'PAGE' END WHEN 2 THEN 'ROW' ELSE 'PAGE' END AS data_compression_desc,
  CASE WHEN l_linenumber = 3 AND l_suppkey % 10 = 4 THEN 0 ELSE count(*) END AS row_count, sum(cast(l_quantity AS bigint)) AS used_page_count,
  sum(cast(l_quantity AS bigint)) * 3 AS in_row_page_count, sum(cast(l_quantity AS bigint)) % 5 AS lob_page_count, sum(cast(l_quantity AS bigint)) % 3 AS overflow_page_count,
  sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS deleted_rows
FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_orderkey % 3
"""

VIEWS["fx_index_usage"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_linenumber - 1 AS int) AS index_id,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS user_seeks, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS user_scans,
  sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS user_lookups, count(*) AS user_updates,
  max(CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE NULL END) AS last_user_seek, max(CASE WHEN l_returnflag = 'A' THEN l_shipdate ELSE NULL END) AS last_user_scan,
  max(CASE WHEN l_linestatus = 'Z' THEN l_shipdate ELSE NULL END) AS last_user_lookup, max(l_shipdate) AS last_user_update
FROM {lineitem} GROUP BY l_suppkey, l_linenumber HAVING l_linenumber <> 5
"""

VIEWS["fx_index_column"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_linenumber - 1 AS int) AS index_id, cast(l_partkey % 6 AS int) AS column_id,
  concat('c', cast(l_partkey % 6 AS varchar(10))) AS column_name,
  CASE WHEN l_partkey % 6 >= 4 THEN 0 ELSE cast(6 - l_partkey % 6 AS int) END AS key_ordinal,
  CASE WHEN l_partkey % 6 = 4 THEN 1 ELSE 0 END AS partition_ordinal,
  CASE WHEN l_partkey % 6 >= 4 THEN 1 ELSE 0 END AS is_included_column, cast(min(l_orderkey) % 2 AS int) AS is_descending_key
FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_partkey % 6
"""

VIEWS["fx_table_column"] = """
SELECT DISTINCT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_partkey % 9 AS int) AS column_id, concat('c', cast(l_partkey % 9 AS varchar(10))) AS column_name
FROM {lineitem}
"""

VIEWS["fx_fragmentation"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  l_suppkey AS object_id, cast(l_linenumber - 1 AS int) AS index_id, cast(count(*) * 37 % 1000 AS double) / 10 AS fragmentation_pct,
  sum(cast(l_quantity AS bigint)) AS page_count, CASE WHEN l_suppkey % 13 = 5 THEN 1 ELSE 0 END AS is_read_only
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""

VIEWS["fx_rowgroup"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name, 'dbo' AS schema_name,
  concat('t', cast(l_suppkey AS varchar(10))) AS table_name, concat('cci', cast(l_linenumber % 2 AS varchar(10))) AS index_name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'CLUSTERED COLUMNSTORE' ELSE 'NONCLUSTERED COLUMNSTORE' END AS type_desc,
  CASE WHEN l_linestatus = 'F' THEN 'COMPRESSED' ELSE 'OPEN' END AS state_description,
  CASE WHEN l_suppkey % 20 = 3 THEN 0 ELSE cast(l_quantity AS bigint) * 100 END AS total_rows, CASE WHEN l_suppkey % 2 = 0 THEN cast(l_quantity AS bigint) ELSE cast(l_quantity AS bigint) * 3 END AS deleted_rows
FROM {lineitem}
"""

VIEWS["fx_fulltext_fragment"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 7 AS varchar(10))) AS database_name,
  concat('cat', cast(l_suppkey % 11 AS varchar(10))) AS catalog_name, l_partkey AS table_id, l_orderkey AS fragment_id
FROM {lineitem}
"""

VIEWS["fx_statistics"] = f"""
SELECT concat('srv', cast(l_orderkey % 3 AS varchar(10))) AS server_name, {_db('l_suppkey % 50')} AS database_name, concat('s', cast(l_partkey % 4 AS varchar(10))) AS schema_name,
  concat('t', cast(l_suppkey AS varchar(10))) AS table_name, l_linenumber AS stats_id
FROM {{lineitem}}
"""

VIEWS["fx_runtime_stats"] = """
SELECT concat('srv', cast(l_partkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_partkey % 7 AS varchar(10))) AS database_name,
  l_partkey AS plan_id, cast(l_quantity AS bigint) AS count_executions,
  cast(floor(l_extendedprice) AS bigint) AS avg_duration_us, cast(floor(l_extendedprice * 0.5) AS bigint) AS avg_cpu_us, l_shipdate AS last_execution_time
FROM {lineitem}
"""

VIEWS["fx_plan"] = """
SELECT concat('srv', cast(p_partkey % 3 AS varchar(10))) AS server_name, concat('db', cast(p_partkey % 7 AS varchar(10))) AS database_name,
  p_partkey AS plan_id, p_partkey AS query_id, CASE WHEN p_partkey % 13 = 0 THEN '<ShowPlanXML><Stmt' ELSE concat('<', pre, 'ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><', pre, 'BatchSequence><', pre, 'Batch><', pre, 'Statements>',
    CASE p_partkey % 4 WHEN 1 THEN '<StmtCond><Condition/><Then><Statements>' WHEN 2 THEN '<StmtCursor><CursorPlan><Operation>' ELSE '' END, '<', pre, 'StmtSimple StatementId="1"><', pre, 'QueryPlan>',
    CASE WHEN p_size % 2 = 0 THEN concat('<', pre, 'MissingIndexes><', pre, 'MissingIndexGroup Impact="', cast(p_size AS varchar(10)), '.5"><', pre, 'MissingIndex Database="[d]" Schema="[dbo]" Table="[', p_brand, ' &amp; co]"/></', pre, 'MissingIndexGroup></', pre, 'MissingIndexes>') ELSE '' END,
    '</', pre, 'QueryPlan>', CASE WHEN p_partkey % 5 = 0 THEN '<StoredProc><Statements><StmtSimple><QueryPlan></QueryPlan></StmtSimple></Statements></StoredProc>' ELSE '' END, '</', pre, 'StmtSimple>',
    CASE p_partkey % 4 WHEN 1 THEN '</Statements></Then></StmtCond>' WHEN 2 THEN '</Operation></CursorPlan></StmtCursor>' ELSE '' END,
    CASE WHEN p_size % 3 = 0 THEN '<StmtSimple><QueryPlan></QueryPlan></StmtSimple>' ELSE '' END, '</', pre, 'Statements></', pre, 'Batch></', pre, 'BatchSequence></', pre, 'ShowPlanXML>') END AS query_plan
FROM (SELECT *, CASE WHEN p_partkey % 7 = 3 THEN 'p:' ELSE '' END AS pre FROM {part}) plans
"""

VIEWS["fx_query_text"] = """
SELECT concat('srv', cast(p_partkey % 3 AS varchar(10))) AS server_name, concat('db', cast(p_partkey % 7 AS varchar(10))) AS database_name,
  p_partkey AS query_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('usp_', p_type) END AS object_name, concat('SELECT * FROM ', p_name) AS query_sql_text
FROM {part}
"""

VIEWS["fx_distribution"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, l_suppkey AS object_id, 1 AS index_id, cast(l_orderkey % 8 AS int) AS distribution_id,
  cast(l_linenumber AS int) AS partition_number, count(*) AS row_count
FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 8, l_linenumber
"""

VIEWS["fx_control"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, l_suppkey AS object_id, 1 AS index_id, 'dbo' AS schema_name, concat('t', cast(l_suppkey AS varchar(10))) AS table_name,
  'HEAP' AS table_type, CASE WHEN l_suppkey % 2 = 0 THEN 'HASH' ELSE 'ROUND_ROBIN' END AS distribution_type,
  cast(1 AS int) AS partition_number, CASE WHEN l_suppkey % 5 = 0 THEN 1000 WHEN l_suppkey % 5 = 1 THEN cast(count(*) * 3 AS bigint) ELSE count(*) END AS row_count
FROM {lineitem} GROUP BY l_suppkey
"""

# --- security -------------------------------------------------------------

VIEWS["fx_principal"] = """
SELECT concat('srv', cast(c_custkey % 3 AS varchar(10))) AS server_name, concat('db', cast(c_nationkey AS varchar(10))) AS database_name,
  c_custkey AS principal_id, CASE c_custkey WHEN 10 THEN 'dbo' WHEN 11 THEN 'guest' WHEN 12 THEN 'sys' ELSE c_name END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'S' WHEN 1 THEN 'U' WHEN 2 THEN 'G' WHEN 3 THEN 'R' ELSE 'Z' END AS type,
  CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_custkey END AS sid, CASE WHEN c_custkey <= 9 THEN 1 ELSE 0 END AS is_fixed_role,
  CASE WHEN c_custkey % 2 = 0 THEN 'SQL_USER' ELSE 'WINDOWS_USER' END AS type_desc, CASE WHEN c_custkey % 7 = 0 THEN 'NONE' ELSE 'INSTANCE' END AS authentication_type_desc
FROM {customer}
"""

VIEWS["fx_server_login"] = """
SELECT concat('srv', cast(c_custkey % 3 AS varchar(10))) AS server_name, c_custkey AS principal_id, concat('login_', c_name) AS name, c_custkey AS sid,
  CASE WHEN c_custkey % 2 = 0 THEN 'SQL_LOGIN' ELSE 'WINDOWS_LOGIN' END AS type_desc, CASE WHEN c_custkey <= 9 THEN 1 ELSE 0 END AS is_fixed_role
FROM {customer}
"""

# the role ids are the fixed roles 0 to 9 of the principals
VIEWS["fx_role_member"] = """
SELECT DISTINCT concat('srv', cast(o_custkey % 3 AS varchar(10))) AS server_name, o_custkey AS member_principal_id,
  cast(CASE WHEN o_orderkey % 8 = 0 THEN 99 ELSE o_custkey % 3 + 3 * (o_orderkey % 3) END AS bigint) AS role_principal_id
FROM {orders}
"""

VIEWS["fx_role"] = """
SELECT concat('srv', cast(c_custkey % 3 AS varchar(10))) AS server_name, c_custkey AS role_principal_id,
  CASE c_custkey WHEN 0 THEN 'db_owner' WHEN 1 THEN 'db_accessadmin' WHEN 2 THEN 'db_backupoperator' WHEN 3 THEN 'db_securityadmin' WHEN 4 THEN 'db_datareader'
    WHEN 5 THEN 'db_owner' WHEN 6 THEN 'db_ddladmin' WHEN 7 THEN 'db_datawriter' WHEN 8 THEN 'db_denydatawriter' ELSE concat('role', cast(c_custkey AS varchar(10))) END AS role_name
FROM {customer}
"""

VIEWS["fx_permission"] = """
SELECT DISTINCT concat('srv', cast(o_custkey % 3 AS varchar(10))) AS server_name, o_custkey AS grantee_principal_id,
  CASE o_orderstatus WHEN 'F' THEN 'DENY' WHEN 'P' THEN NULL ELSE 'GRANT' END AS state_desc, o_orderpriority AS permission_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'SERVER' WHEN 1 THEN 'SERVER_PRINCIPAL' WHEN 2 THEN 'ENDPOINT' ELSE 'OBJECT_OR_COLUMN' END AS class_desc, cast(o_orderkey % 12 AS bigint) AS major_id
FROM {orders}
"""

VIEWS["fx_object_name"] = """
SELECT DISTINCT concat('srv', cast(c_custkey % 3 AS varchar(10))) AS server_name, cast(floor(c_custkey / 3) AS bigint) AS object_id, 'dbo' AS schema_name,
  concat('obj', cast(cast(floor(c_custkey / 3) AS bigint) AS varchar(10))) AS object_name
FROM {customer}
"""

VIEWS["fx_endpoint"] = """
SELECT DISTINCT concat('srv', cast(c_custkey % 3 AS varchar(10))) AS server_name, cast(c_custkey % 9 AS bigint) AS endpoint_id, CASE WHEN c_custkey % 9 < 4 THEN 'TCP' ELSE 'NAMED_PIPES' END AS protocol_desc FROM {customer}
"""

VIEWS["fx_role_permission"] = """
SELECT DISTINCT concat('srv', cast(o_custkey % 3 AS varchar(10))) AS server_name, CASE o_custkey % 9 WHEN 0 THEN 'db_accessadmin' WHEN 1 THEN 'db_backupoperator' WHEN 2 THEN 'db_datareader' WHEN 3 THEN 'db_datawriter'
  WHEN 4 THEN 'db_ddladmin' WHEN 5 THEN 'db_denydatareader' WHEN 6 THEN 'db_denydatawriter' WHEN 7 THEN 'db_owner' ELSE 'db_securityadmin' END AS role_name,
  concat(o_orderpriority, '-', cast(o_orderkey % 5 AS varchar(10))) AS permission_name, CASE o_custkey % 8 WHEN 0 THEN 'bulkadmin' WHEN 1 THEN 'dbcreator' WHEN 2 THEN 'diskadmin' WHEN 3 THEN 'processadmin'
  WHEN 4 THEN 'securityadmin' WHEN 5 THEN 'serveradmin' WHEN 6 THEN 'setupadmin' ELSE 'sysadmin' END AS server_role, 'server' AS entity_name
FROM {orders}
"""

# --- nested documents, dependencies, tasks --------------------------------

VIEWS["fx_assessment"] = """
SELECT r_name AS database_name, concat('Compat', cast(100 + r_regionkey * 10 AS varchar(10))) AS compatibility_level, n_name AS title,
  concat('sev', cast(n_nationkey % 3 AS varchar(10))) AS severity, CASE WHEN n_nationkey % 8 = 5 THEN NULL ELSE concat('imp ', n_name) END AS impact,
  cast(100 + n_nationkey % 5 * 10 AS varchar(10)) AS migrating_to, s_name AS object_name, 'Table' AS object_type, cast(floor(s_suppkey / 50) AS bigint) AS document_id, concat('bal ', cast(cast(floor(s_acctbal) AS bigint) AS varchar(20))) AS impact_detail
FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {supplier} ON s_nationkey = n_nationkey
"""

VIEWS["fx_dependency"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey % 5 AS varchar(10))) AS database_name, 'dbo' AS schema_name, concat('o', cast(l_suppkey AS varchar(10))) AS object_name,
  concat('r', cast(l_partkey % 40 AS varchar(10))) AS referenced_entity_name, CASE WHEN l_partkey % 7 = 0 THEN 'other' ELSE NULL END AS referenced_database_name,
  CASE WHEN l_partkey % 7 = 6 THEN 'link1' ELSE NULL END AS referenced_server_name, CASE WHEN l_partkey % 40 % 3 = 2 THEN NULL ELSE concat('s', cast(l_partkey % 40 % 2 AS varchar(10))) END AS referenced_schema_name,
  cast(CASE WHEN l_partkey % 7 = 3 THEN 1 ELSE 0 END AS int) AS referencing_minor_id, cast(100 + l_partkey % 40 AS int) AS referenced_id,
  cast(CASE WHEN l_partkey % 7 > 2 THEN l_partkey % 7 ELSE 0 END AS int) AS referenced_minor_id, CASE WHEN l_partkey % 7 > 2 THEN concat('c', cast(l_partkey % 7 AS varchar(10))) ELSE NULL END AS referenced_minor_name,
  cast(CASE WHEN l_partkey % 40 = 11 THEN 6 ELSE 1 END AS int) AS referenced_class, CASE WHEN l_partkey % 40 = 11 THEN 'TYPE' ELSE 'OBJECT_OR_COLUMN' END AS referenced_class_desc,
  l_partkey % 40 = 5 AS is_caller_dependent, l_partkey % 40 = 6 AS is_ambiguous, l_partkey % 7 <> 4 AS is_selected, l_partkey % 7 = 4 AS is_updated, l_partkey % 40 = 7 AS is_select_all,
  l_partkey % 40 <> 8 AS is_all_columns_found, l_partkey % 40 = 9 AS is_insert_all, l_partkey % 40 = 10 AS is_incomplete,
  CASE WHEN l_suppkey % 9 = 4 AND l_partkey % 7 = 0 THEN 'cannot resolve' ELSE NULL END AS err_msg
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 40, l_partkey % 7
"""

# every object refers to those with half and a third of its number, some over databases and servers; a few refer back
VIEWS["fx_object_reference"] = """
SELECT concat('srv', cast(k % 3 AS varchar(10))) AS server_name, concat('db', cast(k % 4 AS varchar(10))) AS database_name, 'dbo' AS schema_name, concat('o', cast(k AS varchar(10))) AS object_name,
  CASE WHEN k % 3 = r % 3 THEN NULL ELSE concat('srv', cast(r % 3 AS varchar(10))) END AS referenced_server_name,
  CASE WHEN k % 3 = r % 3 AND k % 4 = r % 4 THEN NULL ELSE concat('db', cast(r % 4 AS varchar(10))) END AS referenced_database_name,
  CASE WHEN r % 5 = 0 THEN NULL ELSE 'dbo' END AS referenced_schema_name, concat('o', cast(r AS varchar(10))) AS referenced_entity_name
FROM (SELECT p_partkey AS k, cast(floor(p_partkey / 2) AS bigint) AS r FROM {part} UNION SELECT p_partkey, cast(floor(p_partkey / 3) AS bigint) FROM {part} WHERE p_partkey % 2 = 1
  UNION SELECT p_partkey, p_partkey * 2 FROM {part} WHERE p_partkey % 50 = 1) pairs WHERE r > 0
"""

VIEWS["fx_module"] = """
SELECT concat('srv', cast(s_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(s_suppkey % 5 AS varchar(10))) AS database_name, 'dbo' AS schema_name, concat('o', cast(s_suppkey AS varchar(10))) AS object_name,
  CASE s_suppkey % 8 WHEN 0 THEN 'P' WHEN 1 THEN 'FN' WHEN 2 THEN 'IF' WHEN 3 THEN 'TF' WHEN 4 THEN 'V' WHEN 5 THEN 'TR' WHEN 6 THEN 'U' ELSE NULL END AS type,
  CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS is_ms_shipped, CASE s_suppkey % 6 WHEN 5 THEN 1 WHEN 4 THEN NULL ELSE 0 END AS is_schema_bound
FROM {supplier}
"""

# one chain per conversation; in every seventh the third task points nowhere
VIEWS["fx_precedence"] = """
SELECT conv_id AS package_id, cast((turn * 5) % 11 AS int) AS edge_index, turn AS from_task,
  CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN turn + 1000 ELSE turn + 1 END AS to_task
FROM {conversations}
"""

VIEWS["fx_task"] = """
SELECT concat('cat', cast(conv_id % 2 AS varchar(10))) AS catalog_name, concat('folder', cast(conv_id % 5 AS varchar(10))) AS folder_name, concat('proj', cast(conv_id % 20 AS varchar(10))) AS project_name,
  conv_id AS package_id, turn AS task_id, concat('Vendor.Tasks.', role, 'Task') AS task_type, concat('task ', cast(turn AS varchar(10))) AS task_name, text AS task_description
FROM {conversations}
"""

# --- snapshots, configuration, history -------------------------------------

VIEWS["fx_database_file"] = """
SELECT concat('srv', cast(l_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(l_suppkey AS varchar(10))) AS database_name,
  concat('log_', cast(l_linenumber AS varchar(10))) AS logical_name, cast(l_linenumber AS int) AS file_id, CASE WHEN l_linenumber = 2 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
  TIMESTAMP '2001-06-01 00:00:00' + INTERVAL '1' SECOND * cast(l_suppkey * 863 % 86400 AS int) AS now_ts
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""

VIEWS["fx_file_database"] = """
SELECT concat('srv', cast(s_suppkey % 3 AS varchar(10))) AS server_name, concat('db', cast(s_suppkey AS varchar(10))) AS database_name,
  CASE WHEN s_suppkey % 9 = 4 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc, CASE WHEN s_suppkey % 8 = 3 THEN cast(s_suppkey AS int) ELSE NULL END AS source_database_guid
FROM {supplier}
"""

VIEWS["fx_log_listing"] = """
SELECT concat('srv', cast(event_id % 3 AS varchar(10))) AS server_name,
  concat('C:', chr(92), 'Logs', chr(92), event_type, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('_', cast(20240000 + event_id % 1231 AS varchar(10))) END, '_', cast(100000 + event_id AS varchar(10)), CASE WHEN event_id % 5 = 0 THEN '.log' ELSE '.txt' END) AS path,
  ts AS modified
FROM {events}
"""

# settings reported by each server: customers are servers here
VIEWS["fx_setting"] = """
SELECT o_custkey AS server_id, concat('srv', cast(o_custkey AS varchar(10)), CASE WHEN o_custkey % 6 = 0 THEN '-OS' ELSE '' END) AS server_name,
  CASE o_orderkey % 7 WHEN 0 THEN 'show advanced options' WHEN 1 THEN 'fill factor (%)' WHEN 2 THEN 'max degree of parallelism' WHEN 3 THEN 'cost threshold for parallelism'
    WHEN 4 THEN 'optimize for ad hoc workloads' WHEN 5 THEN 'remote admin connections' ELSE 'backup compression default' END AS setting_name,
  CASE min(o_orderkey) % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 50 WHEN 3 THEN NULL ELSE 24 END AS setting_value
FROM {orders} GROUP BY o_custkey, o_orderkey % 7
"""

VIEWS["fx_config"] = """
SELECT c_custkey AS server_id, 'Alert Security Events' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1' END AS value FROM {customer}
UNION ALL SELECT o_custkey, 'Backup Path - FULL', max(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('E:', chr(92), o_orderpriority) END) FROM {orders} GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'Backup History Keep Days', cast(count(*) AS varchar(10)) FROM {orders} GROUP BY o_custkey
"""

VIEWS["fx_address"] = """
SELECT event_id, concat(CASE event_id % 5 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' ELSE '10' END, '.', cast(user_id AS varchar(10)), '.', cast(event_id % 256 AS varchar(10)), '.7') AS local_net_address FROM {events}
"""


def dependencies(name: str) -> list[str]:
    """Names of the views a view reads, deepest first, itself last."""
    out: list[str] = []
    for ref in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if ref in VIEWS:
            out += [d for d in dependencies(ref) if d not in out]
    return out + [name]


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, as common table expressions."""
    needed: list[str] = []
    for ref in re.findall(r"\bfx_\w+", sql):
        if ref in VIEWS:
            needed += [d for d in dependencies(ref) if d not in needed]
    if not needed:
        return sql
    ctes = ",\n".join(
        f"{n} AS ({VIEWS[n].format_map(_Names()).strip()})" for n in needed
    )
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if head:
        recursive = head.group(1) or ""
        return f"WITH {recursive}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


class Fixtures:
    """Driver tables and derived views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                df = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
            elif name.endswith("_xml"):
                df = self.derive(name, {"events": spread_small_scan(self("events"))})
            else:
                df = self.derive(name, {})
            self._seen[name] = df
        return self._seen[name]

    def derive(self, name: str, given: dict[str, DataFrame]) -> DataFrame:
        """A view over other inputs, such as a stream instead of a table."""
        refs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
        inputs = {}
        for ref in refs:
            if ref in given:
                inputs[ref] = given[ref]
            elif ref in VIEWS and given:
                inputs[ref] = self.derive(ref, given)
            else:
                inputs[ref] = self(ref)
        df = self.spark.sql(VIEWS[name], **inputs)
        # timestamp literals and date_trunc carry a zone in Spark; the inputs have none
        zoned = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
        return df.withColumns({c: df[c].cast("timestamp_ntz") for c in zoned}) if zoned else df
