"""Restore family: command text and point-in-time chains."""

from __future__ import annotations

from fleetlens.operators import restore as r
from fleetlens.plans.backup import NOW, ts
from fleetlens.plans.registry import query

_NOTE = r.MOVE_NOTE.replace("\t", "' || chr(9) || '")
_CRLF = "chr(13) || chr(10)"
_EXISTS = "EXISTS (SELECT 1 FROM fx_mediafamily m WHERE m.server_name = bs.server_name AND m.media_set_id = bs.media_set_id AND m.device_type = 2)"


def _script(kind: str, p: str) -> str:
    """CTEs <p>lines for one backup type with data path D:\\ and log path L:\\logs."""
    move = f"""
  UNION ALL SELECT server_name, database_name, cast(4.5 AS decimal(3,1)), 0, '{_NOTE}' FROM {p}last
  UNION ALL SELECT s.server_name, s.database_name, cast(5 AS decimal(3,1)), s.backup_set_id, chr(9) || 'MOVE ''' || f.logical_name || ''' TO ''' ||
    CASE WHEN f.file_type = 'L' THEN 'L:\\logs\\' ELSE 'D:\\' END || split_part(f.physical_name, '\\', -1) || ''',' FROM {p}sets s JOIN fx_backupfile f ON f.server_name = s.server_name AND f.backup_set_id = s.backup_set_id
""" if kind == "D" else ""
    return f"""
{p}last AS (SELECT bs.server_name, bs.database_name, max(bs.backup_finish_date) AS finish FROM fx_backupset bs JOIN fx_databases d ON d.server_name = bs.server_name AND d.database_name = bs.database_name
  WHERE bs.type = '{kind}' AND bs.is_copy_only = 0 AND {_EXISTS} GROUP BY 1, 2),
{p}sets AS (SELECT bs.* FROM fx_backupset bs JOIN {p}last l ON l.server_name = bs.server_name AND l.database_name = bs.database_name AND l.finish = bs.backup_finish_date),
{p}files AS (SELECT s.server_name, s.database_name, m.*, max(m.family_sequence_number) OVER (PARTITION BY s.server_name, s.database_name) AS top FROM {p}sets s JOIN fx_mediafamily m ON m.server_name = s.server_name AND m.media_set_id = s.media_set_id AND m.device_type = 2),
{p}lines AS (
  SELECT server_name, database_name, cast(1 AS decimal(3,1)) AS cmd_order, cast(0 AS bigint) AS seq, 'RESTORE DATABASE ' || database_name AS command FROM {p}last
  UNION ALL SELECT server_name, database_name, cast(2 AS decimal(3,1)), 0, 'FROM' FROM {p}last
  UNION ALL SELECT server_name, database_name, cast(3 AS decimal(3,1)), media_set_id * 1000 + family_sequence_number, chr(9) || 'DISK = ''' || physical_device_name || '''' || CASE WHEN family_sequence_number = top THEN '' ELSE ',' END FROM {p}files
  UNION ALL SELECT server_name, database_name, cast(4 AS decimal(3,1)), 0, 'WITH ' FROM {p}last
  UNION ALL SELECT server_name, database_name, cast(6 AS decimal(3,1)), 0, chr(9) || 'REPLACE, NORECOVERY ' || {_CRLF} || {_CRLF} FROM {p}last
  {move})"""


_LOGS = f"""
loglast AS (SELECT bs.server_name, bs.database_name, max(bs.backup_finish_date) AS finish FROM fx_backupset bs JOIN fx_databases d ON d.server_name = bs.server_name AND d.database_name = bs.database_name
  WHERE bs.type IN ('D', 'I') AND bs.is_copy_only = 0 GROUP BY 1, 2),
logs AS (SELECT bs.server_name, bs.database_name, bs.backup_finish_date, bs.media_set_id, m.family_sequence_number,
  'RESTORE DATABASE ' || bs.database_name || {_CRLF} || chr(9) || 'FROM DISK = ''' || m.physical_device_name || '''' || {_CRLF} || 'WITH REPLACE, NORECOVERY ' || {_CRLF} || {_CRLF} AS command
  FROM fx_backupset bs JOIN loglast l ON l.server_name = bs.server_name AND l.database_name = bs.database_name AND bs.backup_finish_date > l.finish
  JOIN fx_mediafamily m ON m.server_name = bs.server_name AND m.media_set_id = bs.media_set_id)"""


@query("restore_commands", f"WITH {_script('D', 'd')} SELECT * FROM dlines")
def restore_commands(t):
    return r.restore_commands(
        t("fx_backupset"), t("fx_mediafamily"), t("fx_backupfile"), t("fx_databases"), data_path="D:", log_path="L:\\logs"
    )


@query("restore_log_commands", f"WITH {_LOGS} SELECT * FROM logs")
def restore_log_commands(t):
    return r.restore_log_commands(t("fx_backupset"), t("fx_mediafamily"), t("fx_databases"))


_ORIGINAL = _script("D", "d").replace("CASE WHEN f.file_type = 'L' THEN 'L:\\logs\\' ELSE 'D:\\' END || split_part(f.physical_name, '\\', -1)", "f.physical_name")


@query("restore_script_all", f"""
WITH {_ORIGINAL}, {_script('I', 'i')}, {_LOGS}
SELECT server_name, database_name, cmd_order, seq, command, 1 AS section, cast(NULL AS timestamp) AS at FROM dlines
UNION ALL SELECT server_name, database_name, cmd_order, seq, command, 2, NULL FROM ilines
UNION ALL SELECT server_name, database_name, cast(1 AS decimal(3,1)), media_set_id * 1000 + family_sequence_number, command, 3, backup_finish_date FROM logs
""")
def restore_script_all(t):
    return r.restore_script_all(t("fx_backupset"), t("fx_mediafamily"), t("fx_backupfile"), t("fx_databases"))


_POINTS = """
req AS (SELECT DISTINCT q.server_name, q.database_name, q.as_of, d.database_guid FROM fx_restore_request q JOIN fx_databases d ON d.server_name = q.server_name AND d.database_name = q.database_name),
f AS (SELECT * FROM (SELECT q.*, bs.backup_finish_date AS full_finish, bs.media_set_id AS full_media_set_id, bs.recovery_model AS full_model, bs.last_lsn AS full_lsn,
    row_number() OVER (PARTITION BY q.server_name, q.database_name, q.as_of ORDER BY bs.backup_finish_date DESC, bs.backup_set_id DESC) AS rn
  FROM req q JOIN fx_backupset bs ON bs.server_name = q.server_name AND bs.database_guid = q.database_guid AND bs.type = 'D' AND bs.is_copy_only = 0 AND bs.backup_finish_date <= q.as_of) WHERE rn = 1),
i AS (SELECT * FROM (SELECT f.server_name, f.database_name, f.as_of, bs.backup_finish_date AS diff_finish, bs.media_set_id AS diff_media_set_id, bs.recovery_model AS diff_model, bs.last_lsn AS diff_lsn,
    row_number() OVER (PARTITION BY f.server_name, f.database_name, f.as_of ORDER BY bs.backup_finish_date DESC, bs.backup_set_id DESC) AS rn
  FROM f JOIN fx_backupset bs ON bs.server_name = f.server_name AND bs.database_guid = f.database_guid AND bs.type = 'I' AND bs.is_copy_only = 0 AND bs.backup_finish_date <= f.as_of AND bs.backup_finish_date > f.full_finish) WHERE rn = 1),
points AS (SELECT f.server_name, f.database_name, f.database_guid, f.as_of, f.full_finish, f.full_media_set_id, f.full_model AS full_recovery_model, i.diff_finish, i.diff_media_set_id,
  coalesce(i.diff_model, f.full_model) AS recovery_model, coalesce(i.diff_lsn, f.full_lsn) AS base_lsn FROM f LEFT JOIN i USING (server_name, database_name, as_of))
"""


@query("restore_points", f"WITH {_POINTS} SELECT * FROM points")
def restore_points(t):
    return r.restore_points(t("fx_backupset"), t("fx_databases"), t("fx_restore_request"))


def _disks(column: str, order: int) -> str:
    return f"""
SELECT p.server_name, p.database_name, p.as_of, cast({order} AS decimal(3,1)), m.media_set_id * 1000 + m.family_sequence_number, chr(9) || 'DISK = ''' || m.physical_device_name || '''' ||
  CASE WHEN m.family_sequence_number = max(m.family_sequence_number) OVER (PARTITION BY p.server_name, p.database_name, p.as_of) THEN '' ELSE ',' END
FROM points p JOIN fx_mediafamily m ON m.server_name = p.server_name AND m.media_set_id = p.{column}"""


_KEYS = "server_name, database_name, as_of"


@query("restore_chain_asof", f"""
WITH {_POINTS},
prevs AS (SELECT bs.*, (SELECT max(p.backup_finish_date) FROM fx_backupset p WHERE p.server_name = bs.server_name AND p.database_guid = bs.database_guid AND p.type = 'L' AND p.backup_finish_date < bs.backup_finish_date) AS prev_finish
  FROM fx_backupset bs WHERE bs.type = 'L')
SELECT {_KEYS}, cast(1 AS decimal(3,1)) AS cmd_order, cast(0 AS bigint) AS seq, 'RESTORE DATABASE ' || database_name AS command FROM points
UNION ALL SELECT {_KEYS}, cast(2 AS decimal(3,1)), 0, 'FROM' FROM points
UNION ALL {_disks('full_media_set_id', 3)}
UNION ALL SELECT {_KEYS}, cast(4 AS decimal(3,1)), 0, 'WITH ' FROM points
UNION ALL SELECT {_KEYS}, cast(4.5 AS decimal(3,1)), 0, '{_NOTE}' FROM points
UNION ALL SELECT p.server_name, p.database_name, p.as_of, cast(5 AS decimal(3,1)), bs.backup_set_id, chr(9) || 'MOVE ''' || f.logical_name || ''' TO ''' || f.physical_name || ''','
  FROM points p JOIN fx_backupset bs ON bs.server_name = p.server_name AND bs.database_guid = p.database_guid AND bs.backup_finish_date = p.full_finish JOIN fx_backupfile f ON f.server_name = bs.server_name AND f.backup_set_id = bs.backup_set_id
UNION ALL SELECT {_KEYS}, cast(6 AS decimal(3,1)), 0, chr(9) || 'REPLACE, NORECOVERY ' FROM points
UNION ALL SELECT {_KEYS}, cast(7 AS decimal(3,1)), 0, 'GO' || {_CRLF} || {_CRLF} FROM points
UNION ALL SELECT {_KEYS}, cast(8 AS decimal(3,1)), 0, 'RESTORE DATABASE ' || database_name FROM points WHERE diff_finish IS NOT NULL
UNION ALL SELECT {_KEYS}, cast(9 AS decimal(3,1)), 0, 'FROM' FROM points WHERE diff_finish IS NOT NULL
UNION ALL {_disks('diff_media_set_id', 10)}
UNION ALL SELECT {_KEYS}, cast(11 AS decimal(3,1)), 0, 'WITH REPLACE, NORECOVERY' || {_CRLF} || 'GO' || {_CRLF} || {_CRLF} FROM points WHERE diff_finish IS NOT NULL
UNION ALL SELECT p.server_name, p.database_name, p.as_of, cast(12 AS decimal(3,1)), cast(epoch(l.backup_finish_date) AS bigint) * 100000 + m.family_sequence_number,
  'RESTORE DATABASE ' || p.database_name || {_CRLF} || chr(9) || 'FROM DISK = ''' || m.physical_device_name || '''' || {_CRLF} || 'WITH REPLACE, NORECOVERY ' ||
  CASE WHEN l.backup_finish_date > p.as_of THEN ', STOPAT = ''' || strftime(p.as_of, '%Y-%m-%d %H:%M:%S') || '''' ELSE '' END || {_CRLF} || {_CRLF}
  FROM points p JOIN prevs l ON l.server_name = p.server_name AND l.database_guid = p.database_guid AND (l.first_lsn >= p.base_lsn OR l.last_lsn >= p.base_lsn) AND l.prev_finish < p.as_of
  JOIN fx_mediafamily m ON m.server_name = l.server_name AND m.media_set_id = l.media_set_id
""")
def restore_chain_asof(t):
    return r.restore_chain_asof(
        t("fx_backupset"), t("fx_mediafamily"), t("fx_backupfile"), t("fx_databases"), t("fx_restore_request")
    )


@query("restore_chain_checks", f"""
WITH {_POINTS},
last_log AS (SELECT bs.server_name, bs.database_name, max(bs.backup_finish_date) AS last_log FROM fx_backupset bs JOIN fx_databases d ON d.server_name = bs.server_name AND d.database_guid = bs.database_guid WHERE bs.type = 'L' GROUP BY 1, 2),
status AS (SELECT q.server_name, q.database_name, q.as_of, CASE WHEN d.database_guid IS NULL THEN 'unknown database' WHEN q.as_of >= TIMESTAMP '{NOW}' THEN 'future point in time'
  WHEN p.recovery_model IS NULL OR p.recovery_model <> 'FULL' THEN 'log chain is broken'
  WHEN (l.last_log IS NULL OR l.last_log < q.as_of) AND d.recovery_model_desc = 'FULL' THEN 'take a tail log backup' WHEN l.last_log IS NULL OR l.last_log < q.as_of THEN 'no log backup since' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT * FROM fx_restore_request) q LEFT JOIN fx_databases d USING (server_name, database_name) LEFT JOIN points p ON p.server_name = q.server_name AND p.database_name = q.database_name AND p.as_of = q.as_of
  LEFT JOIN last_log l ON l.server_name = q.server_name AND l.database_name = q.database_name)
SELECT *, status IN ('unknown database', 'future point in time', 'take a tail log backup') AS stop FROM status
""")
def restore_chain_checks(t):
    return r.restore_chain_checks(t("fx_backupset"), t("fx_databases"), t("fx_restore_request"), now=ts(NOW))
