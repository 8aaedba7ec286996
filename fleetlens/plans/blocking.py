"""Blocking and deadlock family."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import blocking as k
from fleetlens.plans.backup import ts
from fleetlens.plans.registry import query
from fleetlens.session import cut
from fleetlens.sources import shred
from fleetlens.sources.schemas import BLOCKER_FIELDS, VICTIM_FIELDS

NOW = "2024-01-31 00:00:00"
HOURS = 24 * 31


def _typed(kind: str) -> str:
    return {"string": "varchar", "timestamp": "timestamp"}.get(kind, kind)


# attribute texts the input documents carry; every other attribute is absent
_BLK = {
    "status": "'sleeping'", "spid": "b.blk_spid", "ecid": "0", "trancount": "1",
    "lastbatchcompleted": "cast(b.post_time AS date) + INTERVAL '1' SECOND", "clientapp": "'job'",
    "hostname": "'h' || (b.blk_spid % 5)", "hostpid": "b.blk_spid * 7", "loginname": "'u' || b.blk_spid",
    "currentdb": "6", "lockTimeout": "4294967295",
}
_VIC = {
    "taskpriority": "b.vic_spid % 3", "logused": "b.duration_us % 997", "waitresource": "'KEY: 5:' || b.monitor_loop || ' (8194443284a0)'",
    "waittime": "b.duration_us", "transactionname": "'user_transaction'",
    "lasttranstarted": "cast(b.post_time AS date) + INTERVAL '1 hour 2 minutes 3.12 seconds'", "XDES": "'0x' || b.vic_spid",
    "lockMode": "'X'", "status": "'suspended'", "spid": "b.vic_spid", "ecid": "0", "priority": "0", "trancount": "2",
    "lastbatchstarted": "cast(b.post_time AS date) + INTERVAL '4 hours 5 minutes 6 seconds'", "clientapp": "'app & co'",
    "hostname": "'h' || (b.vic_spid % 5)", "loginname": "'u' || b.vic_spid", "isolationlevel": "'read committed (2)'", "currentdb": "5",
}


def _columns(fields: dict[str, str], given: dict[str, str], prefix: str) -> str:
    return ", ".join(f"cast({given.get(n, 'NULL')} AS {_typed(kind)}) AS {prefix}_{n.lower()}" for n, kind in fields.items())


@query("blocked_process_shred", f"""
SELECT x.blocked_process_id, date_trunc('minute', x.post_time + INTERVAL '30' SECOND) AS post_time, d.database_name, x.duration_us // 1000 AS duration_ms, x.index_id, x.is_system, x.server_name,
  x.session_login_name, x.text_data, b.monitor_loop, {_columns(BLOCKER_FIELDS, _BLK, 'blk')}, 'x' AS blk_inputbuf, {_columns(VICTIM_FIELDS, _VIC, 'vic')}, 'SELECT 1 < 2 ' AS vic_inputbuf
FROM fx_blocked_xml x JOIN fx_blocked b USING (blocked_process_id) LEFT JOIN fx_databases d ON d.server_name = x.server_name AND d.database_guid = x.database_id
""")
def blocked_process_shred(t):
    names = t("fx_databases").select("server_name", F.col("database_guid").alias("database_id"), "database_name")
    return shred.blocked_process_shred(t("fx_blocked_xml"), names)


_EDGES = f"""
edges AS (SELECT server_name, blocked_process_id, post_time, monitor_loop, blk_spid, vic_spid, duration_us // 1000 AS duration_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY server_name, monitor_loop, blk_spid, vic_spid ORDER BY blocked_process_id) AS rn FROM fx_blocked
  WHERE blk_spid <> vic_spid AND post_time >= TIMESTAMP '{NOW}' - INTERVAL '{HOURS}' HOUR) WHERE rn = 1),
flagged AS (SELECT e.*, e.blk_spid NOT IN (SELECT v.vic_spid FROM edges v WHERE v.server_name = e.server_name AND v.monitor_loop = e.monitor_loop) AS is_lead_blocker FROM edges e)
"""


def _edges(t):
    return k.blocked_process_dedupe(shred.blocked_edges(t("fx_blocked_xml")), now=ts(NOW), hours=HOURS)


@query("blocked_process_dedupe", f"WITH {_EDGES} SELECT * FROM edges")
def blocked_process_dedupe(t):
    return _edges(t)


@query("lead_blockers", f"WITH {_EDGES} SELECT * FROM flagged")
def lead_blockers(t):
    return k.lead_blockers(_edges(t))


def _metrics(flagged: str) -> str:
    """Recursive walk from every lead; a path that meets itself marks its lead."""
    return f"""
WITH RECURSIVE {flagged},
walk AS (SELECT blocked_process_id AS lead_id, server_name, monitor_loop, vic_spid, duration_ms, [blk_spid, vic_spid] AS path, false AS again FROM flagged WHERE is_lead_blocker
  UNION ALL SELECT w.lead_id, f.server_name, f.monitor_loop, f.vic_spid, f.duration_ms, list_append(w.path, f.vic_spid), list_contains(w.path, f.vic_spid) FROM walk w
    JOIN flagged f ON f.server_name = w.server_name AND f.monitor_loop = w.monitor_loop AND f.blk_spid = w.vic_spid WHERE NOT f.is_lead_blocker AND NOT w.again),
sums AS (SELECT lead_id, bool_or(again) AS again, count(*) AS n, cast(sum(duration_ms) AS bigint) AS total FROM walk GROUP BY 1)
SELECT f.*, CASE WHEN NOT again THEN n END AS spids_blocked, CASE WHEN NOT again THEN total END AS total_duration_ms, CASE WHEN NOT again THEN total // n END AS avg_duration_ms,
  CASE WHEN again THEN 'cycle' ELSE 'complete' END AS chain_status FROM flagged f JOIN sums s ON s.lead_id = f.blocked_process_id
"""


# edges that close circles on one server: from a victim back to its blocker, and over three sessions
_LOOPED = _EDGES.replace("flagged AS", """
planted AS (SELECT * FROM edges
  UNION ALL SELECT server_name, -blocked_process_id, post_time, monitor_loop, vic_spid, blk_spid, 7 FROM edges WHERE server_name = 'srv1' AND blocked_process_id % 40 = 27
  UNION ALL SELECT x.server_name, -1000000000 - x.blocked_process_id, x.post_time, x.monitor_loop, x.vic_spid, y.blk_spid, 9 FROM edges x JOIN edges y ON y.server_name = x.server_name AND y.monitor_loop = x.monitor_loop AND y.blocked_process_id = x.blocked_process_id + 1
    WHERE x.server_name = 'srv1' AND x.blocked_process_id % 60 = 31 AND x.vic_spid <> y.blk_spid),
flagged AS""").replace("FROM edges e)", "FROM planted e)").replace("SELECT v.vic_spid FROM edges v", "SELECT v.vic_spid FROM planted v")


def _looped(t):
    edges = cut(_edges(t))  # read several times below: the reports are parsed once
    here = edges.where("server_name = 'srv1'")
    back = here.where("blocked_process_id % 40 = 27").select(
        "server_name", (-F.col("blocked_process_id")).alias("blocked_process_id"), "post_time", "monitor_loop",
        F.col("vic_spid").alias("blk_spid"), F.col("blk_spid").alias("vic_spid"), F.lit(7).cast("bigint").alias("duration_ms"),
    )
    following = here.select("server_name", "monitor_loop", (F.col("blocked_process_id") - 1).alias("blocked_process_id"), F.col("blk_spid").alias("_to"))
    around = here.where("blocked_process_id % 60 = 31").join(following, ["server_name", "monitor_loop", "blocked_process_id"]).where("vic_spid <> _to").select(
        "server_name", (-1_000_000_000 - F.col("blocked_process_id")).alias("blocked_process_id"), "post_time", "monitor_loop",
        F.col("vic_spid").alias("blk_spid"), F.col("_to").alias("vic_spid"), F.lit(9).cast("bigint").alias("duration_ms"),
    )
    return edges.unionByName(back).unionByName(around)


@query("blocking_chain_metrics", _metrics(_EDGES))
def blocking_chain_metrics(t):
    return k.blocking_chain_metrics(k.lead_blockers(_edges(t)))


@query("blocking_chain_status", _metrics(_LOOPED))
def blocking_chain_status(t):
    """Chains with cycles on one server: its leads above them get a status, all others their figures."""
    return k.blocking_chain_metrics(k.lead_blockers(_looped(t)))


@query("blocking_cycles", f"""
WITH RECURSIVE {_LOOPED},
reach AS (SELECT server_name, monitor_loop, blk_spid AS a, vic_spid AS b FROM planted UNION SELECT r.server_name, r.monitor_loop, r.a, p.vic_spid FROM reach r JOIN planted p ON p.server_name = r.server_name AND p.monitor_loop = r.monitor_loop AND p.blk_spid = r.b),
mutual AS (SELECT x.server_name, x.monitor_loop, x.a, x.b FROM reach x JOIN reach y ON y.server_name = x.server_name AND y.monitor_loop = x.monitor_loop AND y.a = x.b AND y.b = x.a)
SELECT server_name, monitor_loop, min(b) AS cycle_id, count(*) AS sessions, a AS spid FROM mutual GROUP BY server_name, monitor_loop, a
""")
def blocking_cycles(t):
    return k.blocking_cycles(_looped(t))


_DEADLOCK = """
SELECT server_name, event_id, object_name, cast(cast(ts AS date) AS timestamp) + INTERVAL '1' HOUR * cast(event_id % 10 AS int) + INTERVAL '30' MINUTE - INTERVAL '5' HOUR AS timestamp,
  regexp_extract(event_data, '<deadlock>.*</deadlock>') AS xml_deadlock_report,
  cast(regexp_extract(event_data, 'process spid="([0-9]+)" clientapp', 1) AS bigint) AS spid_vic, 'app' AS clientapp_vic, 'h1' AS hostname_vic, 'u1' AS loginname_vic, 'a < b' AS inputbuf_vic,
  try_cast(regexp_extract(event_data, 'process spid="([0-9]+)" loginname', 1) AS bigint) AS spid_win, cast(NULL AS varchar) AS clientapp_win, cast(NULL AS varchar) AS hostname_win,
  CASE WHEN event_id % 10 <> 0 THEN 'u2' END AS loginname_win, CASE WHEN event_id % 10 <> 0 THEN 'b' END AS inputbuf_win
FROM fx_deadlock_xml
"""


@query("deadlock_shred", _DEADLOCK)
def deadlock_shred(t):
    return shred.deadlock_shred(t("fx_deadlock_xml"), zone="America/New_York")
