"""Alert family: rules, throttle, counters, drives and waits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import alerts as a
from fleetlens.plans.backup import ts
from fleetlens.plans.registry import query
from fleetlens.session import stage_path
from fleetlens.sources import shred
from fleetlens.streaming import batches, stateful
from fleetlens.streaming import handlers as h
from fleetlens.streaming.runs import read_files, run_to_parquet


def _sql(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


_RULES = "rules(alert_name, severity, message_id, keyword, event_class, delay_seconds) AS (VALUES " + ", ".join(
    "(" + ", ".join(_sql(v) for v in rule) + ")" for rule in a.RULES
) + ")"
_MATCHED = f"""{_RULES},
matched AS (SELECT e.*, r.alert_name, r.delay_seconds FROM fx_alert_event e JOIN rules r ON r.severity = e.severity
  UNION ALL SELECT e.*, r.alert_name, r.delay_seconds FROM fx_alert_event e JOIN rules r ON r.message_id = e.error_number WHERE r.keyword IS NULL OR contains(lower(e.description), lower(r.keyword))
  UNION ALL SELECT e.*, r.alert_name, r.delay_seconds FROM fx_alert_event e JOIN rules r ON r.event_class = e.event_class)
"""


def _matched(t):
    return a.alert_rule_match(t("fx_alert_event"), a.standard_rules(t.spark))


def _slower(alerts, seconds: int):
    """The same alerts with a longer delay, to suppress more than the standard one."""
    return alerts.withColumn("delay_seconds", F.when(F.col("delay_seconds") > 0, F.lit(seconds)).otherwise(F.lit(0)))


@query("alert_rule_match", f"WITH {_MATCHED} SELECT * FROM matched")
def alert_rule_match(t):
    return _matched(t)


def _throttled(seconds: int) -> str:
    return f"""{_MATCHED},
inst AS MATERIALIZED (SELECT server_name, alert_name, ts, min(event_id) AS event_id FROM matched WHERE delay_seconds > 0 GROUP BY 1, 2, 3),
nxt AS MATERIALIZED (SELECT x.server_name, x.alert_name, x.ts, y.ts AS following FROM inst x ASOF JOIN inst y ON y.server_name = x.server_name AND y.alert_name = x.alert_name AND x.ts + INTERVAL '{seconds}' SECOND <= y.ts),
walk AS (SELECT server_name, alert_name, min(ts) AS ts FROM inst GROUP BY 1, 2 UNION ALL SELECT n.server_name, n.alert_name, n.following FROM walk w JOIN nxt n ON n.server_name = w.server_name AND n.alert_name = w.alert_name AND n.ts = w.ts),
held AS (SELECT i.server_name, i.alert_name, i.event_id, i.ts FROM inst i JOIN walk w ON w.server_name = i.server_name AND w.alert_name = i.alert_name AND w.ts = i.ts),
responses AS (SELECT * FROM held UNION ALL SELECT server_name, alert_name, event_id, ts FROM matched WHERE delay_seconds = 0)
"""


@query("alert_throttle", f"WITH RECURSIVE {_throttled(600)} SELECT * FROM responses")
def alert_throttle(t):
    return a.alert_throttle(_matched(t))


@query("alert_throttle_12h", f"WITH RECURSIVE {_throttled(43200)} SELECT * FROM responses")
def alert_throttle_12h(t):
    return a.alert_throttle(_slower(_matched(t), 43200))


def _throttle_stream(t, seconds: int):
    """Responses of a file stream in the sink, and those that wait behind its last watermark."""
    source = read_files(t.spark, f"{t.sf_dir}/events.parquet", files_per_trigger=4)
    events = t.derive("fx_alert_event", {"events": source})
    alerts = _slower(a.alert_rule_match(events, a.standard_rules(t.spark)), seconds)
    checkpoint = stage_path(t.spark, "throttle-offsets")
    passed = run_to_parquet(stateful.alert_throttle_stream(alerts), "throttle", checkpoint=checkpoint)
    return passed.unionByName(stateful.throttle_tail(t.spark, checkpoint))


@query("alert_throttle_stream", f"WITH RECURSIVE {_throttled(600)} SELECT * FROM held")
def alert_throttle_stream(t):
    """Keyed state over a file stream, with the standard delay."""
    return _throttle_stream(t, 600)


@query("alert_throttle_stream_whole", f"WITH RECURSIVE {_throttled(43200)} SELECT * FROM held")
def alert_throttle_stream_whole(t):
    """The same with a delay of 12 hours."""
    return _throttle_stream(t, 43200)


def _walked(rows: str, out: str, seconds: int) -> str:
    """CTE ``out``: the responses among the alerts of ``rows``, step by step."""
    return f"""
{out}_i AS MATERIALIZED (SELECT server_name, alert_name, ts, min(event_id) AS event_id FROM {rows} GROUP BY 1, 2, 3),
{out}_n AS MATERIALIZED (SELECT x.server_name, x.alert_name, x.ts, y.ts AS following FROM {out}_i x ASOF JOIN {out}_i y ON y.server_name = x.server_name AND y.alert_name = x.alert_name AND x.ts + INTERVAL '{seconds}' SECOND <= y.ts),
{out}_w AS (SELECT server_name, alert_name, min(ts) AS ts FROM {out}_i GROUP BY 1, 2 UNION ALL SELECT n.server_name, n.alert_name, n.following FROM {out}_w w JOIN {out}_n n ON n.server_name = w.server_name AND n.alert_name = w.alert_name AND n.ts = w.ts),
{out} AS (SELECT i.* FROM {out}_i i JOIN {out}_w w ON w.server_name = i.server_name AND w.alert_name = i.alert_name AND w.ts = i.ts)"""


_DELIVERIES = ("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'", "ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'",
               "ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("late_alerts", f"""
WITH RECURSIVE {_MATCHED},
due AS (SELECT server_name, alert_name, ts, event_id, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND ts <= (SELECT max(ts) FROM fx_alert_event) - INTERVAL '10' MINUTE AS late FROM matched WHERE delay_seconds > 0),
punctual AS (SELECT * FROM due WHERE NOT late), {_walked("punctual", "given", 43200)},
again AS (SELECT server_name, alert_name, ts, event_id FROM due WHERE late UNION ALL SELECT server_name, alert_name, ts, NULL FROM given), {_walked("again", "corrected", 43200)},
all_keys AS (SELECT server_name, alert_name, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM due GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM given g WHERE g.server_name = k.server_name AND g.alert_name = k.alert_name) AS responses,
  (SELECT count(event_id) FROM corrected c WHERE c.server_name = k.server_name AND c.alert_name = k.alert_name) AS corrections FROM all_keys k
""")
def late_alerts(t):
    """Three deliveries of a stream, the last one late: rows on time, late rows, responses and corrections by alert."""
    folder, path, checkpoint = (stage_path(t.spark, n) for n in ("deliveries", "late", "late-offsets"))
    for part in _DELIVERIES:
        t("events").where(part).write.mode("append").parquet(folder)
        events = t.derive("fx_alert_event", {"events": read_files(t.spark, folder)})
        alerts = _slower(a.alert_rule_match(events, a.standard_rules(t.spark)), 43200).where("delay_seconds > 0")
        batches.route_late(alerts, "ts", path=path, checkpoint=checkpoint)
    on_time, late = (batches.read_output(t.spark, path, n, alerts.schema) for n in ("on_time", "late"))
    offsets = stage_path(t.spark, "throttle-offsets")
    given = run_to_parquet(stateful.alert_throttle_stream(read_files(t.spark, f"{path}/on_time/*")), "throttle", checkpoint=offsets)
    given = given.unionByName(stateful.throttle_tail(t.spark, offsets))
    corrected = batches.late_corrections(given, late)
    kinds = {"on_time": on_time, "late": late, "responses": given, "corrections": corrected}
    counts = None
    for name, rows in kinds.items():
        one = rows.select(*a.ALERT, *[F.lit(int(name == k)).alias(k) for k in kinds])
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy(*a.ALERT).agg(*[F.sum(k).cast("bigint").alias(k) for k in kinds])


@query("alert_occurrence_counter", f"""
WITH RECURSIVE {_throttled(43200)},
both_kinds AS (SELECT server_name, alert_name, ts, 0 AS kind FROM matched UNION ALL SELECT server_name, alert_name, ts, 1 FROM responses)
SELECT server_name, alert_name, count(*) FILTER (kind = 0) AS occurrence_count, max(ts) FILTER (kind = 0) AS last_occurrence, max(ts) FILTER (kind = 1) AS last_response FROM both_kinds
WHERE NOT (alert_name BETWEEN '17' AND '26' OR alert_name LIKE 'Error 82_') OR ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2
""")
def alert_occurrence_counter(t):
    alerts = _slower(_matched(t), 43200)
    return a.alert_occurrence_counter(alerts, a.alert_throttle(alerts), reset_at=ts("2024-01-20 00:00:00"))


_OPERATORS = {"DBA team": 1, "Pager": 2}


@query("alert_notification_routing", f"""
WITH {_MATCHED},
defined AS (SELECT DISTINCT s.server_name, r.alert_name FROM (SELECT DISTINCT server_name FROM fx_alert_event) s, rules r),
known AS (SELECT DISTINCT server_name, alert_name, CASE WHEN description LIKE 'x CLIENT%' THEN 'Pager' WHEN event_id % 5 = 0 THEN 'Other' ELSE 'DBA team' END AS operator_name FROM matched WHERE event_id % 50 = 7 OR event_id % 5 = 0 AND event_id % 35 = 0)
SELECT d.server_name, d.alert_name, o.operator_name, o.method, CASE WHEN k.alert_name IS NULL THEN 'add' ELSE 'update' END AS action
FROM defined d JOIN (VALUES ('DBA team', 1), ('Pager', 2)) o(operator_name, method) ON true LEFT JOIN known k ON k.server_name = d.server_name AND k.alert_name = d.alert_name AND k.operator_name = o.operator_name
WHERE substr(d.alert_name, 1, 2) IN ('17', '18', '19', '20', '21', '22', '23', '24', '25') OR d.alert_name = '26' OR substr(d.alert_name, 1, 9) IN ('Error 823', 'Error 824') OR d.alert_name = 'Error 825'
""")
def alert_notification_routing(t):
    """All alerts of the rule set on every server, against notifications known from all kinds of alerts."""
    rules = a.standard_rules(t.spark).select("alert_name").distinct()
    defined = t("fx_alert_event").select("server_name").distinct().join(F.broadcast(rules))  # one row a server and rule
    method = F.when(F.col("event_id") % 2 == 0, 1).otherwise(4)
    name = F.when(F.col("description").like("x CLIENT%"), "Pager").when(F.col("event_id") % 5 == 0, "Other").otherwise("DBA team")
    some = (F.col("event_id") % 50 == 7) | ((F.col("event_id") % 5 == 0) & (F.col("event_id") % 35 == 0))
    known = _matched(t).where(some).select("server_name", "alert_name", name.alias("operator_name"), method.alias("method"))
    return a.alert_notification_routing(defined, known, _OPERATORS)


@query("notification_text", """
SELECT server_name, event_id, 'DATE/TIME:' || chr(9) || strftime(ts, '%m/%d/%Y %H:%M:%S') || chr(13) || chr(10) || chr(13) || chr(10) || 'DESCRIPTION:' || chr(9) || description || chr(13) || chr(10) || chr(13) || chr(10)
  || 'COMMENT:' || chr(9) || '(None)' || chr(13) || chr(10) || chr(13) || chr(10) || 'JOB RUN:' || chr(9) || '(None)' AS body FROM fx_alert_event WHERE description NOT LIKE '%CLIENT: 10.0.42.20%'
""")
def notification_text(t):
    tokens = t("fx_alert_event").withColumns({"date_token": F.date_format("ts", "yyyyMMdd"), "time_token": F.date_format("ts", "HHmmss")})
    return a.notification_text(tokens, ignore_client="10.0.42.20")


def _updates(samples: str, threshold: int, seconds: int) -> str:
    """CTE ``upd``: low samples with the state flag, folded row by row."""
    return f"""
low AS (SELECT server_name, drive, sample_time, mb_free, row_number() OVER (PARTITION BY server_name, drive ORDER BY sample_time) AS n FROM {samples} WHERE mb_free < {threshold}),
upd AS (SELECT server_name, drive, sample_time, mb_free, n, true AS updated, mb_free AS amount, sample_time AS alerted FROM low WHERE n = 1
  UNION ALL SELECT l.server_name, l.drive, l.sample_time, l.mb_free, l.n, l.mb_free <> u.amount OR u.alerted < l.sample_time - INTERVAL '{seconds}' SECOND, l.mb_free,
    CASE WHEN l.mb_free <> u.amount OR u.alerted < l.sample_time - INTERVAL '{seconds}' SECOND THEN l.sample_time ELSE u.alerted END
  FROM upd u JOIN low l ON l.server_name = u.server_name AND l.drive = u.drive AND l.n = u.n + 1)"""


_MESSAGES = """
SELECT server_name, sample_time, CASE WHEN bool_or(updated) THEN 17 ELSE 16 END AS severity, 'Warning: one or more disk drives is running out of free space:' || chr(13) || chr(10)
  || string_agg(drive || ':' || chr(9) || mb_free || ' MB' || chr(13) || chr(10), '' ORDER BY drive) AS message FROM upd GROUP BY 1, 2
"""
_WAIT = {"threshold_mb": 1024, "repeat_minutes": 150}


@query("free_space_updates", f"WITH RECURSIVE {_updates('fx_drive_sample', 1024, 9000)} SELECT server_name, drive, sample_time, mb_free, updated FROM upd")
def free_space_updates(t):
    return a.free_space_updates(t("fx_drive_sample"), **_WAIT)


@query("free_space_alerts", f"WITH RECURSIVE {_updates('fx_drive_sample', 1024, 9000)} {_MESSAGES}")
def free_space_alerts(t):
    return a.free_space_alerts(t("fx_drive_sample"), **_WAIT)


_GROWTH = """
growth AS (SELECT DISTINCT server_name, post_time AS check_time FROM fx_server_event WHERE event_id % 97 <> 13 AND event_type IN ('DATA_FILE_AUTO_GROW', 'LOG_FILE_AUTO_GROW')),
drives AS (SELECT DISTINCT server_name, drive FROM fx_drive_sample),
checks AS (SELECT d.server_name, d.drive, g.check_time FROM growth g JOIN drives d ON d.server_name = g.server_name),
grown AS (SELECT c.server_name, c.drive, c.check_time AS sample_time, s.mb_free FROM checks c ASOF JOIN fx_drive_sample s ON s.server_name = c.server_name AND s.drive = c.drive AND s.sample_time <= c.check_time)
"""


def _growth(t):
    return h.growth_events(shred.server_event_shred(t("fx_server_event_xml")))


@query("growth_triggered_samples", f"WITH {_GROWTH} SELECT * FROM grown")
def growth_triggered_samples(t):
    return a.growth_triggered_samples(_growth(t), t("fx_drive_sample"))


@query("autogrow_trigger", f"WITH RECURSIVE {_GROWTH}, {_updates('grown', 2048, 9000)} {_MESSAGES}")
def autogrow_trigger(t):
    samples = a.growth_triggered_samples(_growth(t), t("fx_drive_sample"))
    return a.free_space_alerts(samples, threshold_mb=2048, repeat_minutes=150)


@query("reset_drive_state", "SELECT DISTINCT server_name, drive, cast(-1 AS int) AS last_amount_mb, TIMESTAMP '1900-01-01 00:00:00' AS last_alert FROM fx_drive_sample")
def reset_drive_state(t):
    return a.reset_drive_state(t("fx_drive_sample"))


@query("volume_low_space", """
WITH sized AS (SELECT DISTINCT server_name, volume_mount_point AS drive, cast(total_bytes // 1048576 AS int) AS total_mb, cast(available_bytes // 1048576 AS int) AS free_mb, cast(available_bytes * 100 // total_bytes AS int) AS free_pct FROM fx_volume),
low AS (SELECT * FROM sized WHERE free_pct <= 10 OR free_mb <= 10240)
SELECT l.*, m.message FROM low l JOIN (SELECT server_name, 'The following drives have less than 10% free space or less than 10 GB free space (or both):' || chr(13) || chr(10) || string_agg(drive || chr(13) || chr(10), '' ORDER BY drive) AS message
  FROM (SELECT DISTINCT server_name, drive FROM low) GROUP BY 1) m USING (server_name)
""")
def volume_low_space(t):
    return a.volume_low_space(t("fx_volume"))


@query("counter_snapshot", "SELECT server_name, ts AS sample_time, date_diff('second', start_time, ts) AS seconds_since_startup, pages_read_since_startup FROM fx_counter WHERE counter_object LIKE '%Buffer Manager%' AND counter_name = 'Page reads/sec'")
def counter_snapshot(t):
    return a.counter_snapshot(t("fx_counter"))


@query("allowlist_check", """
WITH judged AS (SELECT *, NOT (length(engine_login) > 0 AND contains('dom\\engine, engine@corp.example', lower(engine_login))) AS engine_bad, NOT (length(agent_login) > 0 AND contains('dom\\agent', lower(agent_login))) AS agent_bad FROM fx_service_login)
SELECT server_id, engine_login, agent_login, CASE WHEN engine_bad THEN 'The login of the engine service was changed to "' || engine_login || '". Please change it back to "dom\\Engine" and restart the service.' END AS engine_finding,
  CASE WHEN agent_bad THEN 'The login of the agent service was changed to "' || agent_login || '". Please change it back to "dom\\agent" and restart the service.' END AS agent_finding FROM judged WHERE engine_bad OR agent_bad
""")
def allowlist_check(t):
    return a.allowlist_check(t("fx_service_login"), engine_allowed="dom\\Engine, engine@corp.example", agent_allowed="dom\\agent")


@query("benign_wait_filter", "SELECT server_name, wait_type, cast(sum(wait_ms) AS bigint) AS wait_ms, count(*) AS samples FROM fx_counter WHERE wait_type NOT IN ('SLEEP_TASK', 'WAITFOR') GROUP BY 1, 2")
def benign_wait_filter(t):
    return a.benign_wait_filter(t("fx_counter"))
