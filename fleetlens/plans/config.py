"""Configuration, snapshots, listings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import config as c
from fleetlens.plans.backup import ts
from fleetlens.plans.registry import query
from fleetlens.session import stage_path
from fleetlens.sources import files, shred

def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_ITEMS = "items(name, description, standard) AS (VALUES " + ", ".join(
    "(" + ", ".join(_text(v) for v in item) + ")" for item in c.config_items()
) + ")"
_SEED = f"""{_ITEMS},
seeded AS (SELECT f.server_id, f.name, f.value, i.description FROM fx_config f LEFT JOIN items i ON i.name = f.name
  UNION ALL SELECT s.c_custkey, i.name, '', i.description FROM customer s JOIN items i ON true WHERE NOT EXISTS (SELECT 1 FROM fx_config f WHERE f.server_id = s.c_custkey AND f.name = i.name))
"""
_SITE = {
    "login": "dom\\DBA,dom\\admin", "team": "DBA Team", "mail": "dba@example.com", "host": "smtp.example.com", "domain": "DOM", "certificate": "BackupCertificate",
}
_FULL = "i.standard"
for _name, _value in _SITE.items():
    _FULL = f"replace({_FULL}, '{{{_name}}}', '{_value}')"
_FILLED = f"""{_SEED},
filled AS (SELECT e.server_id, e.name, CASE WHEN coalesce(e.value, '') <> '' THEN e.value ELSE coalesce(CASE WHEN s.c_custkey % 3 = 0 AND contains(i.standard, '{{address}}') THEN NULL
    ELSE replace(replace(replace({_FULL}, '{{server}}', s.c_name), '{{address}}', '10.' || s.c_nationkey || '.0.1'), '{{encryption}}', cast(s.c_custkey % 2 AS varchar)) END, e.value) END AS value, e.description FROM seeded e LEFT JOIN items i ON i.name = e.name LEFT JOIN customer s ON s.c_custkey = e.server_id)
"""


def _seed(t):
    return c.config_seed(t("fx_config"), t("customer").select(F.col("c_custkey").alias("server_id")))


def _fill(t):
    servers = t("customer").select(
        F.col("c_custkey").alias("server_id"), F.col("c_name").alias("server"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("10."), "c_nationkey", F.lit(".0.1"))).alias("address"),
        (F.col("c_custkey") % 2).alias("encryption"),
    )
    return c.config_fill(_seed(t), servers, site=_SITE)


@query("config_seed", f"WITH {_SEED} SELECT * FROM seeded")
def config_seed(t):
    return _seed(t)


@query("config_fill", f"WITH {_FILLED} SELECT * FROM filled")
def config_fill(t):
    return _fill(t)


@query("config_gaps", f"WITH {_FILLED} SELECT * FROM filled WHERE coalesce(value, '') = '' AND name <> 'ALTER DATABASE - Temporary Allowed Logins'")
def config_gaps(t):
    """Backup paths stay empty where the address of a server is not known."""
    return c.config_gaps(_fill(t))


_ASKED = "CASE WHEN o_orderkey % 2 = 0 THEN 'Alert Security Events' ELSE 'Trace Flags' END"


@query("config_lookup", f"SELECT q.request_id, q.server_id, q.name, coalesce(f.value, '') AS value FROM (SELECT o_orderkey AS request_id, o_custkey AS server_id, {_ASKED} AS name FROM orders) q LEFT JOIN fx_config f ON f.server_id = q.server_id AND f.name = q.name")
def config_lookup(t):
    requests = t("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("server_id"), F.expr(_ASKED).alias("name"))
    return c.config_lookup(requests, t("fx_config"))


@query("config_drift", """
WITH judged AS (SELECT server_name, setting_name, setting_value, cast(CASE WHEN setting_name = 'show advanced options' AND setting_value IS DISTINCT FROM 1 THEN 1 WHEN setting_name = 'fill factor (%)' AND setting_value IS DISTINCT FROM 0 THEN 0
  WHEN setting_name = 'max degree of parallelism' AND setting_value = 1 THEN 0 WHEN setting_name = 'cost threshold for parallelism' AND setting_value < 25 THEN 25 WHEN setting_name = 'optimize for ad hoc workloads' AND server_name LIKE '%-OS' AND setting_value = 0 THEN 1
  WHEN setting_name = 'remote admin connections' AND setting_value = 0 THEN 1 WHEN setting_name = 'backup compression default' AND (setting_value IS NULL OR setting_value = 0) THEN 1 END AS int) AS desired_value FROM fx_setting)
SELECT * FROM judged WHERE desired_value IS NOT NULL
""")
def config_drift(t):
    return c.config_drift(t("fx_setting"))


@query("database_setting_drift", """
SELECT server_name, database_name, 'page verify' AS setting, 'ALTER DATABASE [' || database_name || '] SET PAGE_VERIFY CHECKSUM  WITH NO_WAIT;' AS command FROM fx_databases WHERE page_verify_option_desc <> 'CHECKSUM'
UNION ALL SELECT server_name, database_name, 'recovery model', 'ALTER DATABASE [' || database_name || '] SET RECOVERY FULL WITH NO_WAIT;' FROM fx_databases
WHERE recovery_model_desc = 'SIMPLE' AND database_name NOT IN ('master', 'tempdb', 'msdb', 'DbaData') AND database_name NOT LIKE 'ReportServer%TempDB'
""")
def database_setting_drift(t):
    return c.database_setting_drift(t("fx_databases"))


@query("network_segment_map", """
WITH cut AS (SELECT event_id, local_net_address, split_part(local_net_address, '.', 1) || '.' || split_part(local_net_address, '.', 2) || '.' || split_part(local_net_address, '.', 3) AS segment FROM fx_address)
SELECT *, CASE WHEN segment LIKE '172.30.%' THEN segment || '.202' WHEN segment LIKE '172.%' THEN '172.20.50.200' ELSE segment || '.62' END AS target_host FROM cut
""")
def network_segment_map(t):
    return c.network_segment_map(t("fx_address"), {"172.30.": ".202", "172.": "172.20.50.200"}, default=".62")


_SUFFIX = "strftime(now_ts, '%Y%m%d') || '_' || strftime(make_timestamp(((epoch_us(now_ts) // 1000000 + 300) // 600) * 600000000), '%H%M')"


@query("snapshot_names", f"""
WITH named AS (SELECT f.*, f.database_name || '_' || {_SUFFIX} AS snapshot_name FROM fx_database_file f JOIN fx_file_database d ON d.server_name = f.server_name AND d.database_name = f.database_name WHERE f.type_desc <> 'LOG' AND d.state_desc = 'ONLINE' AND d.source_database_guid IS NULL)
SELECT server_name, database_name, snapshot_name, 'CREATE DATABASE [' || snapshot_name || '] ON ' || string_agg('(Name = ''' || logical_name || ''', FILENAME = ''D:\\snap\\' || snapshot_name || '.' || file_id || '.snp'')', ', ' ORDER BY file_id) || ' AS SNAPSHOT OF [' || database_name || '];' AS command
FROM named GROUP BY 1, 2, 3
""")
def snapshot_names(t):
    return c.snapshot_names(t("fx_database_file"), t("fx_file_database"), now=F.col("now_ts"), data_path="D:\\snap")


@query("snapshot_xref", """
SELECT s.server_name, s.database_name AS snapshot_database, d.database_name AS source_database FROM fx_databases s LEFT JOIN fx_databases d ON d.server_name = s.server_name AND d.database_guid = s.source_database_guid WHERE s.source_database_guid IS NOT NULL
""")
def snapshot_xref(t):
    return c.snapshot_xref(t("fx_databases"))


@query("purge_log_files", "SELECT * FROM fx_log_listing WHERE regexp_matches(split_part(path, '\\', -1), '^.*_.{8}_.{6}\\.txt$') AND modified < TIMESTAMP '2024-02-10 00:00:00' - INTERVAL '30' DAY")
def purge_log_files(t):
    return files.purge_log_files(t("fx_log_listing"), now=ts("2024-02-10 00:00:00"))


@query("deadlock_export", """
SELECT server_name, strftime(shifted, '%Y-%m-%d') AS day, event_id, strftime(shifted, '%Y-%m-%d ~ %H_%M_%S.000') AS name, regexp_extract(event_data, '<deadlock>.*</deadlock>') AS document
FROM (SELECT *, cast(cast(ts AS date) AS timestamp) + INTERVAL '1' HOUR * cast(event_id % 10 AS int) + INTERVAL '30' MINUTE - INTERVAL '5' HOUR AS shifted FROM fx_deadlock_xml)
""")
def deadlock_export(t):
    reports = shred.deadlock_shred(t("fx_deadlock_xml"), zone="America/New_York")
    return files.deadlock_export(reports, stage_path(t.spark, "deadlocks"))
