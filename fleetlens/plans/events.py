"""Event files and event handlers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import events as e
from fleetlens.plans.registry import query
from fleetlens.session import stage_path
from fleetlens.sources import documents, shred
from fleetlens.sources.fixtures import Fixtures
from fleetlens.sources.tables import spread_small_scan
from fleetlens.streaming import batches, rechecks
from fleetlens.streaming import handlers as h
from fleetlens.streaming.runs import read_files, run_to_parquet

# --- event files ----------------------------------------------------------

_NUMBER = "cast(18400 + event_id % 100 AS int)"
_SEVERITY = "cast(8 + event_id % 16 AS int)"
_MESSAGE = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'k & v' || chr(10) || user_id END"


def _null(*names: str, kind: str = "varchar") -> str:
    return ", ".join(f"cast(NULL AS {kind}) AS {n}" for n in names)


@query("error_event_shred", f"""
SELECT 'srv' || (event_id % 3) AS server_name, event_id, 'error_reported' AS object_name, cast(cast(ts AS date) AS timestamp) AS timestamp, event_type AS category, {_null('client_app_name', 'client_hostname', 'destination', 'file', 'function', 'server_principal_name', 'sql_text')},
  'db' || (event_id % 50) AS database_name, {_null('error', 'line', kind='bigint')}, {_NUMBER} AS error_number, {_null('is_intercepted', kind='boolean')}, {_MESSAGE} AS message, {_SEVERITY} AS severity,
  cast(1 AS int) AS state, event_id % 2 = 0 AS user_defined, 'u' || user_id AS username FROM events
""")
def error_event_shred(t):
    return shred.error_event_shred(t("fx_error_xml"))


@query("ring_buffer_explode", f"""
SELECT 'srv' || ((event_id // 20) % 3) AS server_name, cast(user_id AS int) AS session_id, 'error_reported' AS event_name, cast(cast(ts AS date) AS timestamp) AS event_time, {_NUMBER} AS error_number, {_SEVERITY} AS severity, '1' AS state,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS user_defined, event_type AS category, {_null('destination', 'is_intercepted', 'sql_text')}, {_MESSAGE} AS message FROM events
""")
def ring_buffer_explode(t):
    return shred.ring_buffer_explode(t("fx_ring_xml"))


_DOCUMENTS = f"""
SELECT 'srv' || ((event_id // 20) % 3) AS server_name, 'error_reported' AS object_name, cast(cast(ts AS date) AS timestamp) AS timestamp, event_type AS category, 'db' || (event_id % 50) AS database_name,
  {_NUMBER} AS error_number, {_MESSAGE} AS message, {_SEVERITY} AS severity, event_id % 2 = 0 AS user_defined, 'u' || user_id AS username FROM events
"""
_DOCUMENT_COLUMNS = ["server_name", "object_name", "timestamp", "category", "database_name", "error_number", "message", "severity", "user_defined", "username"]


def _exported(t) -> str:
    """Ring-buffer documents as text files by server, as an export leaves them."""
    folder = stage_path(t.spark, "exported")
    t("fx_ring_xml").select("server_name", F.col("target_data").alias("value")).write.partitionBy("server_name").text(folder)
    return folder


@query("event_documents", _DOCUMENTS)
def event_documents(t):
    rows = documents.named_events(documents.event_documents(t.spark, _exported(t)))
    return shred.error_event_shred(rows).select(*_DOCUMENT_COLUMNS)


@query("event_documents_stream", _DOCUMENTS)
def event_documents_stream(t):
    """The same files as a stream, through a checkpointed sink."""
    rows = documents.named_events(documents.event_documents(t.spark, _exported(t), stream=True, files_per_trigger=4))
    return run_to_parquet(shred.error_event_shred(rows).select(*_DOCUMENT_COLUMNS), "documents")


@query("error_event_filter", f"SELECT event_id, {_NUMBER} AS error_number, {_SEVERITY} AS severity FROM events WHERE 8 + event_id % 16 > 10 AND 18400 + event_id % 100 <> 18456")
def error_event_filter(t):
    rows = shred.error_event_shred(t("fx_error_xml"))
    return e.error_event_filter(rows).select("event_id", "error_number", "severity")


@query("session_error_filter", "SELECT * FROM fx_statement WHERE message <> '' AND severity > 10 AND session_id = 7")
def session_error_filter(t):
    return e.session_error_filter(t("fx_statement"), session_id=7)


@query("slow_statement_filter", """
SELECT * FROM fx_statement WHERE (name IN ('module_end', 'rpc_completed', 'sp_statement_completed', 'sql_statement_completed') AND duration_us >= 250000) OR name = 'cursor_execute' OR (name = 'error_reported' AND message <> '' AND severity > 10)
""")
def slow_statement_filter(t):
    return e.slow_statement_filter(t("fx_statement"))


@query("error_html_rows", f"""
SELECT 'srv' || (event_id % 3) AS server_name, event_id, '<tr><td>db' || (event_id % 50) || '</td><td>' || {_NUMBER} || '</td><td>' || coalesce(replace(replace({_MESSAGE}, '&', '&amp;'), chr(10), '<br/>'), '') || '</td></tr>' AS html FROM events
""")
def error_html_rows(t):
    rows = shred.error_event_shred(t("fx_error_xml"))
    return e.error_html_rows(rows, ["database_name", "error_number", "message"], keep=["server_name", "event_id"])


# --- handlers -------------------------------------------------------------


def _row(name: str, value: str) -> str:
    return f"coalesce('<tr><td>{name}</td><td>' || {value} || '</td></tr>', '')"


def _row_if(condition: str, name: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {_row(name, value)} ELSE '' END"


_HTML = " || ".join([
    "'<table border=\"1\">'", _row("EventType", "event_type"), _row("PostTime", "replace(cast(post_time AS varchar), ' ', 'T')"), _row_if("event_id % 4 = 1", "SPID", "event_id % 90"),
    _row_if("event_id % 4 <> 2", "ServerName", "server_name"), _row("LoginName", "login_name"), _row_if("event_id % 4 = 2", "ServerName", "server_name"),
    _row("DatabaseName", "database_name"), _row("SchemaName", "schema_name"), _row("ObjectName", "object_name"), _row("TargetObjectType", "target_object_type"),
    _row("RoleName", "role_name"), _row("TextData", "command_text"), _row("EventSubClass", "event_subclass"), _row("Success", "success"), _row("IsSystem", "is_system"),
    _row_if("event_id % 3 = 0", "HostName", "'h &amp; 1'"), _row_if("event_id % 3 = 0", "Empty", "''"), _row("TSQLCommand", "command_text"), "'</table><br/>'",
])
_EV = f"ev AS (SELECT v.*, x.message_body, {_HTML.replace('event_id', 'v.event_id').replace('post_time', 'v.post_time').replace('server_name', 'v.server_name')} AS html FROM fx_server_event v JOIN fx_server_event_xml x ON x.event_id = v.event_id WHERE v.event_id % 97 <> 13)"
_TRUSTED = "(login_name ILIKE '%DBA%' OR login_name ILIKE '%MSSqlAdmin%')"


def _alert_sql(where: str, subject: str = "server_name || ' -- ' || event_type", reason: str = "cast(NULL AS varchar)") -> str:
    return f"""
SELECT server_name, event_id, post_time, {subject} AS subject, {reason} AS reason, coalesce('<p>' || {reason} || '</p><br/>', '') || html AS body FROM ev WHERE {where}"""


def _events(t):
    return shred.server_event_shred(t("fx_server_event_xml"))


@query("event_to_html", f"WITH {_EV} SELECT event_id, html FROM ev")
def event_to_html(t):
    return h.good_events(_events(t)).select("event_id", e.event_to_html(F.col("message_body")).alias("html"))


_SHRED = """
SELECT event_id, post_time, server_name, event_type, login_name, database_name, schema_name, object_name, target_object_type, role_name, command_text, success, is_system, event_subclass FROM fx_server_event WHERE event_id % 97 <> 13
"""


@query("server_event_shred", _SHRED)
def server_event_shred(t):
    return h.good_events(_events(t)).drop("corrupt", "message_body", "event")


@query("event_stream_base", _SHRED)
def event_stream_base(t):
    """The same rows through a file stream and a checkpointed parquet sink."""
    source = read_files(t.spark, f"{t.sf_dir}/events.parquet")
    stream = shred.server_event_shred(t.derive("fx_server_event_xml", {"events": source}))
    return run_to_parquet(h.good_events(stream).drop("corrupt", "message_body", "event"), "events")


@query("event_quarantine", "SELECT x.server_name, x.event_id, x.post_time, x.message_body FROM fx_server_event_xml x WHERE x.event_id % 97 = 13")
def event_quarantine(t):
    return h.quarantined_events(_events(t))


@query("audit_append", f"WITH {_EV} SELECT server_name, event_id, event_type AS event_name, message_body AS event_data, post_time AS event_time FROM ev")
def audit_append(t):
    source = read_files(t.spark, f"{t.sf_dir}/events.parquet")
    stream = shred.server_event_shred(t.derive("fx_server_event_xml", {"events": source}))
    return run_to_parquet(h.audit_append(h.good_events(stream)), "audit")


@query("backup_restore_alerts", f"""
WITH {_EV.replace('ev AS (', 'ev0 AS (')},
judged AS (SELECT v.*, d.state_desc, d.database_name IS NOT NULL AS known, coalesce(NOT {_TRUSTED.replace('login_name', 'v.login_name')}, false) AS untrusted, v.event_subclass = 2 AND v.command_text ILIKE '%RESTORE%DATABASE%' AS restore
  FROM ev0 v LEFT JOIN fx_databases d ON d.server_name = v.server_name AND d.database_name = v.database_name WHERE v.event_type = 'AUDIT_BACKUP_RESTORE_EVENT'),
ev AS (SELECT *, CASE WHEN NOT restore OR command_text ILIKE '%NORECOVERY%' THEN NULL WHEN NOT known THEN 'Restored database no longer exists:' WHEN state_desc IN ('OFFLINE', 'RECOVERY PENDING', 'SUSPECT', 'EMERGENCY') THEN 'Restored database is not ONLINE:'
  WHEN coalesce(state_desc, '') = '' THEN 'Database state is unknown:' END AS problem FROM judged)
{_alert_sql("(event_subclass IN (1, 3) AND untrusted) OR (restore AND (untrusted OR problem IS NOT NULL))", reason="problem")}
""")
def backup_restore_alerts(t):
    return h.backup_restore_alerts(_events(t), t("fx_databases"))


@query("restores_to_recheck", f"""
WITH {_EV} SELECT v.server_name, v.event_id, v.post_time, v.database_name, v.message_body FROM ev v JOIN fx_databases d ON d.server_name = v.server_name AND d.database_name = v.database_name
WHERE v.event_type = 'AUDIT_BACKUP_RESTORE_EVENT' AND v.event_subclass = 2 AND v.command_text ILIKE '%RESTORE%DATABASE%' AND v.command_text NOT ILIKE '%NORECOVERY%' AND d.state_desc IN ('RESTORING', 'RECOVERING')
""")
def restores_to_recheck(t):
    return h.restores_to_recheck(_events(t), t("fx_databases"))


@query("login_alerts", f"WITH {_EV} " + _alert_sql("event_type IN ('AUDIT_LOGIN', 'AUDIT_LOGIN_FAILED') AND lower(login_name) = 'sa'", "server_name || ' - [sa] Login'", "CASE WHEN success = 0 THEN 'Login Failed' ELSE 'Login Succeeded' END"))
def login_alerts(t):
    return h.login_alerts(_events(t))


@query("owner_change_alerts", f"WITH {_EV} " + _alert_sql("event_type = 'AUDIT_CHANGE_DATABASE_OWNER'"))
def owner_change_alerts(t):
    return h.owner_change_alerts(_events(t))


@query("dbcc_alerts", f"WITH {_EV} " + _alert_sql(f"event_type = 'AUDIT_DBCC_EVENT' AND success = 1 AND NOT {_TRUSTED} AND command_text NOT ILIKE '%SHOW_STATISTICS%' AND (lower(login_name) <> 'sa' OR is_system <> 1)"))
def dbcc_alerts(t):
    return h.dbcc_alerts(_events(t))


@query("deadlock_events", f"WITH {_EV} SELECT server_name, event_id, post_time, server_name || ' -- ' || event_type AS subject, html AS body, command_text AS attachment FROM ev WHERE event_type = 'DEADLOCK_GRAPH'")
def deadlock_events(t):
    return h.deadlock_events(_events(t))[0]


def _together(name: str, where: str, alert: str, audit: str) -> str:
    return f"""
SELECT '{name} alert' AS output, server_name, event_id, post_time, {alert} AS text FROM ev WHERE {where}
UNION ALL SELECT '{name} audit', server_name, event_id, post_time, {audit} FROM ev WHERE {where}"""


@query("outputs_together", f"WITH {_EV} " + " UNION ALL ".join([
    _together("deadlock", "event_type = 'DEADLOCK_GRAPH'", "html", "message_body"),
    _together("deprecation", "event_type IN ('DEPRECATION_ANNOUNCEMENT', 'DEPRECATION_FINAL_SUPPORT') AND lower(database_name) <> 'msdb'", "html", "message_body"),
    "SELECT 'quarantine', x.server_name, x.event_id, x.post_time, x.message_body FROM fx_server_event_xml x WHERE x.event_id % 97 = 13",
]))
def outputs_together(t):
    """Five outputs of one read of the event stream: mails and audit rows of two families, and what could not be read."""
    stream = read_files(t.spark, f"{t.sf_dir}/events.parquet", files_per_trigger=4)

    def messages(batch):
        here = Fixtures(batch.sparkSession, t.sf_dir)
        return shred.server_event_shred(here.derive("fx_server_event_xml", {"events": spread_small_scan(batch)})).drop("event")

    def outputs(batch, high):
        deadlock, deprecation = h.deadlock_events(batch), h.deprecation_events(batch)
        alert = lambda df: df.select("server_name", "event_id", "post_time", F.col("body").alias("text"))
        audit = lambda df: df.select("server_name", "event_id", F.col("event_time").alias("post_time"), F.col("event_data").alias("text"))
        return {
            "deadlock alert": alert(deadlock[0]), "deadlock audit": audit(deadlock[1]),
            "deprecation alert": alert(deprecation[0]), "deprecation audit": audit(deprecation[1]),
            "quarantine": h.quarantined_events(batch).withColumnRenamed("message_body", "text"),
        }

    path = batches.run_together(stream, outputs, prepare=messages)
    rows = None
    for name in ("deadlock alert", "deadlock audit", "deprecation alert", "deprecation audit", "quarantine"):
        one = batches.read_output(t.spark, path, name, "server_name string, event_id bigint, post_time timestamp_ntz, text string")
        one = one.select(F.lit(name).alias("output"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


_VERDICTS = "CASE WHEN state_desc = 'ONLINE' THEN 1 WHEN state_desc = '' THEN 2 WHEN state_desc IN ('OFFLINE', 'RECOVERY PENDING', 'SUSPECT', 'EMERGENCY') THEN 3 ELSE 0 END"
_OUTCOMES = f"""
WITH r AS (SELECT server_name, database_name, event_id, post_time, post_time + INTERVAL '2' DAY AS until FROM fx_restore_event WHERE event_type = 'AUDIT_BACKUP_RESTORE_EVENT' AND event_subclass = 2 AND command_text NOT ILIKE '%NORECOVERY%'),
s AS (SELECT server_name, database_name, snapshot_time, max({_VERDICTS}) AS verdict FROM fx_database_state GROUP BY 1, 2, 3),
m AS (SELECT r.event_id, min(snapshot_time) FILTER (verdict > 0) AS decided_at, arg_min(verdict, snapshot_time) FILTER (verdict > 0) AS verdict, count(snapshot_time) AS n
  FROM r LEFT JOIN s ON s.server_name = r.server_name AND s.database_name = r.database_name AND s.snapshot_time BETWEEN r.post_time AND r.until GROUP BY 1),
o AS (SELECT r.*, coalesce(decided_at, until) AS ended_at, CASE WHEN verdict = 1 THEN 'online' WHEN verdict = 2 THEN 'unknown' WHEN verdict = 3 THEN 'not online' WHEN n > 0 THEN 'unfinished' ELSE 'gone' END AS outcome FROM r JOIN m USING (event_id))
SELECT server_name, database_name, event_id, post_time, outcome, ended_at, CASE outcome WHEN 'not online' THEN 'Restored database is not ONLINE:' WHEN 'unknown' THEN 'Database state is unknown:' WHEN 'gone' THEN 'Restored database no longer exists:'
  WHEN 'unfinished' THEN 'Restore has not ended in time:' END AS reason FROM o
"""


@query("restore_outcomes", _OUTCOMES)
def restore_outcomes(t):
    """Restores followed through the snapshots of the database states."""
    return rechecks.restore_outcomes(rechecks.followed_restores(t("fx_restore_event")), t("fx_database_state"), timeout="2 days")


@query("restore_outcomes_stream", _OUTCOMES)
def restore_outcomes_stream(t):
    """The same as a stream of restores and one of snapshots; what is still open is judged by what the state holds."""
    source = lambda: read_files(t.spark, f"{t.sf_dir}/events.parquet", files_per_trigger=4)
    restores = rechecks.followed_restores(t.derive("fx_restore_event", {"events": source()}))
    states = t.derive("fx_database_state", {"events": source()})
    offsets = stage_path(t.spark, "restores-offsets")
    stream = rechecks.restore_outcomes_stream(restores, states, timeout_seconds=2 * 86400)
    ended = run_to_parquet(stream, "restores", checkpoint=offsets)
    return ended.unionByName(rechecks.open_outcomes(t.spark, offsets, timeout="2 days"))


@query("deadlock_audit", f"WITH {_EV} SELECT server_name, event_id, event_type AS event_name, message_body AS event_data, post_time AS event_time FROM ev WHERE event_type = 'DEADLOCK_GRAPH'")
def deadlock_audit(t):
    return h.deadlock_events(_events(t))[1]


_DEPRECATED = "event_type IN ('DEPRECATION_ANNOUNCEMENT', 'DEPRECATION_FINAL_SUPPORT') AND database_name <> 'msdb'"


@query("deprecation_events", f"WITH {_EV} " + _alert_sql(_DEPRECATED))
def deprecation_events(t):
    return h.deprecation_events(_events(t))[0]


@query("deprecation_audit", f"WITH {_EV} SELECT server_name, event_id, event_type AS event_name, message_body AS event_data, post_time AS event_time FROM ev WHERE {_DEPRECATED}")
def deprecation_audit(t):
    return h.deprecation_events(_events(t))[1]


@query("ddl_audit_log", f"""
WITH {_EV}
SELECT server_name, event_id, event_type AS event_name, CASE WHEN target_object_type = 'Server' THEN 'Server' WHEN database_name <> '' THEN 'Database' END AS scope, post_time AS event_time, message_body AS event_data FROM ev
WHERE event_type NOT IN ('CREATE_STATISTICS', 'UPDATE_STATISTICS', 'DROP_STATISTICS', 'ALTER_QUEUE', 'CREATE_QUEUE', 'DROP_QUEUE', 'CREATE_CONTRACT', 'DROP_CONTRACT', 'CREATE_MESSAGE_TYPE', 'DROP_MESSAGE_TYPE', 'CREATE_SERVICE', 'DROP_SERVICE')
  AND NOT (event_type = 'ALTER_INDEX' AND (command_text ILIKE '%REBUILD%' OR command_text ILIKE '%REORGANIZE%' OR command_text ILIKE '%DISABLE%')) AND NOT (event_type = 'ALTER_TABLE' AND command_text ILIKE '%SWITCH%PARTITION%')
  AND (database_name IS NULL OR database_name <> 'SSISDB')
  AND NOT EXISTS (SELECT 1 FROM fx_shipped_object o WHERE o.is_ms_shipped = 1 AND o.server_name = ev.server_name AND o.database_name = ev.database_name AND o.schema_name = ev.schema_name AND o.object_name = ev.object_name)
""")
def ddl_audit_log(t):
    return h.ddl_audit_log(_events(t), t("fx_shipped_object"))


def _family_sql() -> str:
    whens = " ".join(
        "WHEN event_type IN (" + ", ".join(f"'{x}'" for x in types) + f") THEN '{name}'" for name, types in h.SECURITY_FAMILIES.items()
    )
    return f"CASE {whens} END"


@query("security_ddl_audit", f"""
WITH {_EV}, fam AS (SELECT *, {_family_sql()} AS family FROM ev)
SELECT server_name, event_id, post_time, event_type AS event_name, family, true AS to_audit, true AS to_alert, CASE event_type WHEN 'ADD_SERVER_ROLE_MEMBER' THEN 'server role policy' WHEN 'ADD_ROLE_MEMBER' THEN 'database role policy' END AS handler, message_body AS event_data
FROM fam WHERE family IS NOT NULL
""")
def security_ddl_audit(t):
    return h.security_ddl_audit(_events(t))


_ALLOWED = "Dom\\DBA, u4"
_LISTED = "(length(login_name) > 0 AND contains('dom\\dba, u4', lower(login_name)))"


@query("role_policy_violations", f"""
WITH {_EV}
SELECT server_name, event_id, post_time, login_name, database_name, role_name, object_name, CASE WHEN event_type = 'ADD_SERVER_ROLE_MEMBER' THEN 'server role' ELSE 'database role' END AS policy,
  CASE WHEN event_type = 'ADD_SERVER_ROLE_MEMBER' THEN 'ALTER SERVER ROLE [' || role_name || '] DROP MEMBER [' || object_name || ']' ELSE '[' || database_name || ']..sp_executesql N''ALTER ROLE [' || role_name || '] DROP MEMBER [' || object_name || ']''' END AS undo_command
FROM ev WHERE NOT {_LISTED} AND ((event_type = 'ADD_SERVER_ROLE_MEMBER' AND lower(role_name) IN ('sysadmin', 'serveradmin', 'securityadmin', 'diskadmin', 'dbcreator'))
  OR (event_type = 'ADD_ROLE_MEMBER' AND lower(role_name) IN ('db_owner', 'db_accessadmin', 'db_backupoperator', 'db_securityadmin') AND object_name NOT IN ('RSExecRole', 'SchemaCreator')))
""")
def role_policy_violations(t):
    return h.role_policy_violations(_events(t), allowed_logins=_ALLOWED)


_KINDS = """
('SET RECOVERY', 'the RECOVERY model'), ('MODIFY FILE', 'database files'), ('SET PAGE_VERIFY', 'PAGE_VERIFY'), ('SET AUTO_SHRINK', 'AUTO_SHRINK'), ('SET AUTO_CLOSE', 'AUTO_CLOSE'),
('SET AUTO_UPDATE_STATISTICS', 'AUTO_UPDATE_STATISTICS (or AUTO_UPDATE_STATISTICS_ASYNC)'), ('SET AUTO_CREATE_STATISTICS', 'AUTO_CREATE_STATISTICS (or AUTO_CREATE_STATISTICS_ASYNC)')
"""


@query("alter_database_policy", f"""
WITH {_EV}
SELECT server_name, event_id, post_time, login_name, command_text, server_name || ' - Database Altered' AS subject,
  CASE WHEN contains('u5', lower(login_name)) THEN NULL ELSE (SELECT 'Altering ' || f.what || ' is not permitted in production environments.' || chr(13) || chr(10) || chr(13) || chr(10) || command_text FROM (VALUES {_KINDS}) f(word, what) WHERE contains(upper(command_text), f.word)) END AS violation, html AS body
FROM ev WHERE event_type = 'ALTER_DATABASE' AND NOT {_LISTED}
""")
def alter_database_policy(t):
    return h.alter_database_policy(_events(t), allowed_logins=_ALLOWED, temporary_logins="U5")


@query("drop_database_policy", f"""
WITH {_EV}
SELECT server_name, event_id, post_time, login_name, server_name || ' - Database Dropped' AS subject, CASE WHEN NOT {_LISTED} THEN
  'Dropping databases is not permitted in production environments.' || chr(13) || chr(10) || chr(13) || chr(10) || 'TSql Command: ' || command_text || chr(13) || chr(10) || 'Login Name: ' || login_name END AS violation, html AS body
FROM ev WHERE event_type = 'DROP_DATABASE'
""")
def drop_database_policy(t):
    return h.drop_database_policy(_events(t), allowed_logins=_ALLOWED)


@query("instance_change_alerts", f"WITH {_EV} " + _alert_sql(f"event_type = 'CREATE_DATABASE' OR (event_type = 'ALTER_INSTANCE' AND NOT {_TRUSTED})", "server_name || CASE WHEN event_type = 'ALTER_INSTANCE' THEN ' - Instance Altered' ELSE ' - Database Created' END"))
def instance_change_alerts(t):
    return h.instance_change_alerts(_events(t))


@query("maintenance_window_filter", "SELECT event_id, post_time FROM fx_server_event WHERE NOT (dayname(post_time) = 'Sunday' AND cast(post_time AS time) BETWEEN TIME '00:00:00' AND TIME '17:00:00')")
def maintenance_window_filter(t):
    return h.maintenance_window_filter(t("fx_server_event").select("event_id", "post_time"))
