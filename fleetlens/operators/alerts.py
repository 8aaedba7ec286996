"""Alert rules, throttling, counters and the free-space monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.joins import small_side
from fleetlens.functions.numbers import int_div, seconds_between
from fleetlens.functions.ordered import asof_latest, latest_so_far
from fleetlens.operators.throttle import throttle
from fleetlens.session import cut

RULE_SCHEMA = "alert_name string, severity int, message_id int, keyword string, event_class string, delay_seconds int"
# fixed values: the standard alert rules
RULES = [
    ("17-Insufficient Resources", 17, None, None, None, 600),
    ("18-Nonfatal Internal Error", 18, None, None, None, 600),
    ("19-Fatal Error in Resource", 19, None, None, None, 600),
    ("20-Fatal Error in Current Process", 20, None, None, None, 600),
    ("21-Fatal Error in Database Processes", 21, None, None, None, 600),
    ("22-Fatal Error: Table Integrity Suspect", 22, None, None, None, 600),
    ("23-Fatal Error: Database Integrity Suspect", 23, None, None, None, 600),
    ("24-Fatal Error: Hardware Error", 24, None, None, None, 600),
    ("25-Fatal Error", 25, None, None, None, 600),
    ("Error 823", None, 823, None, None, 600),
    ("Error 824", None, 824, None, None, 600),
    ("Error 825", None, 825, None, None, 600),
    ("Failed sa Login Attempt", None, 18456, "Login failed for user 'sa'. Reason: Password did not match that for the login provided.", None, 0),
    ("Autogrowth - data file", None, None, None, "DATA_FILE_AUTO_GROW", 0),
    ("Autogrowth - log file", None, None, None, "LOG_FILE_AUTO_GROW", 0),
    ("Blocked Process Report", None, None, None, "BLOCKED_PROCESS_REPORT", 0),
]
# fixed values: wait types of an idle server
BENIGN_WAITS = (
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "BROKER_TRANSMITTER",
    "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE",
    "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DBMIRRORING_CMD",
    "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT", "FT_IFTSHC_MUTEX", "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "MEMORY_ALLOCATION_EXT",
    "ONDEMAND_TASK_QUEUE", "PREEMPTIVE_XE_GETTARGETSTATE", "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_ASYNC_QUEUE", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK", "RESOURCE_QUEUE", "REQUEST_FOR_DEADLOCK_SEARCH", "SERVER_IDLE_CHECK",
    "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT", "SQLTRACE_BUFFER_FLUSH", "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES",
    "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN", "WAIT_XTP_RECOVERY", "WAIT_XTP_HOST_WAIT",
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_CKPT_CLOSE", "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
)
DRIVE = ["server_name", "drive"]
ALERT = ["server_name", "alert_name"]


def standard_rules(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """Rules as a literal relation, so that the optimizer knows how small they are."""
    row = F.array(*[F.struct(*[F.lit(v) for v in rule]) for rule in rules])
    return spark.sql("SELECT 1").select(F.inline(row.cast(f"array<struct<{RULE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")))


def alert_rule_match(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per event and matching rule.

    An event offers its severity, message id and class as keys, a rule asks for one
    of them, so the match is a single equi join over a single pass of the events;
    the description keyword is checked on the matches of the message id.  The rules
    are broadcast when their measured size allows it, since a severity is no key to
    shuffle events on.
    """
    def keys(message: str) -> Column:
        return F.array(*[
            F.struct(F.lit(kind).alias("_kind"), F.col(column).cast("string").alias("_value"))
            for kind, column in (("severity", "severity"), ("message", message), ("class", "event_class"))
        ])

    asked = rules.select("alert_name", "delay_seconds", F.col("keyword").alias("_keyword"), F.inline(keys("message_id")))
    asked = small_side(asked.where(F.col("_value").isNotNull()))
    offered = events.select("*", F.inline(keys("error_number"))).where(F.col("_value").isNotNull())
    found = (F.col("_kind") != "message") | F.col("_keyword").isNull() | F.contains(F.lower("description"), F.lower("_keyword"))
    return offered.join(asked, ["_kind", "_value"]).where(found).select(*events.columns, "alert_name", "delay_seconds")


def alert_throttle(alerts: DataFrame) -> DataFrame:
    """Alerts that get a response: at most one per delay, server and alert.

    A delay of 0 never suppresses.  Of several alerts at the same instant the one
    with the lowest event id responds.
    """
    free = alerts.where("delay_seconds = 0")
    held = cut(
        alerts.where("delay_seconds > 0")
        .groupBy(*ALERT, "ts", "delay_seconds").agg(F.min("event_id").alias("event_id"))
        .withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("_delay_us", F.col("delay_seconds").cast("bigint") * 1_000_000)
    )
    hits = throttle(held, ALERT, "_at", "_delay_us")
    columns = [*ALERT, "event_id", "ts"]
    return free.select(*columns).unionByName(held.join(hits, [*ALERT, "_at"], "left_semi").select(*columns))


def resettable(name: Column) -> Column:
    """Alerts whose history the reset clears."""
    return name.between("17", "26") | name.like("Error 82_")


def alert_occurrence_counter(alerts: DataFrame, responses: DataFrame, *, reset_at: Column | None = None) -> DataFrame:
    """Occurrences, last occurrence and last response per server and alert.

    After a reset only later rows of the resettable alerts count.
    """
    def live(df: DataFrame) -> DataFrame:
        return df if reset_at is None else df.where(~resettable(F.col("alert_name")) | (F.col("ts") > reset_at))

    count = F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0))
    both = live(alerts).select(*ALERT, "ts", F.lit(0).alias("_kind")).unionByName(
        live(responses).select(*ALERT, "ts", F.lit(1).alias("_kind"))
    )
    return both.groupBy(*ALERT).agg(
        count.alias("occurrence_count"),
        F.max(F.when(F.col("_kind") == 0, F.col("ts"))).alias("last_occurrence"),
        F.max(F.when(F.col("_kind") == 1, F.col("ts"))).alias("last_response"),
    )


def notified(name: Column) -> Column:
    """Alerts that operators are told of: severities 17 to 25 and the read errors 823 to 825, by name."""
    return name.between("17", "26") | name.between("Error 823", "Error 825")


def alert_notification_routing(alerts: DataFrame, existing: DataFrame, operators: dict[str, int]) -> DataFrame:
    """What brings every wanted alert to every operator by the operator's method.

    ``alerts`` (server_name, alert_name) are the alerts defined on the servers, ``existing`` (server_name,
    alert_name, operator_name, method) the notifications there are, ``operators`` the wanted operators with
    their method.  Returns server_name, alert_name, operator_name, method and action: 'add' where the
    notification is missing, 'update' where it exists, since it may have another method.  Notifications
    of other operators stay as they are and are not listed.
    """
    people = F.array(*[F.struct(F.lit(o).alias("operator_name"), F.lit(m).alias("method")) for o, m in operators.items()])
    wanted = alerts.where(notified(F.col("alert_name"))).select("server_name", "alert_name").distinct()
    wanted = wanted.select("*", F.inline(people))
    key = ["server_name", "alert_name", "operator_name"]
    there = existing.select(*key).distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, key, "left").select(*key, "method", F.when(F.col("_there"), "update").otherwise("add").alias("action"))


def notification_text(alerts: DataFrame, *, ignore_client: str | None = None) -> DataFrame:
    """Mail text from ``date_token`` (yyyymmdd) and ``time_token`` (hhmmss)."""
    rows = alerts
    if ignore_client is not None:
        rows = rows.where(~F.col("description").like(f"%CLIENT: {ignore_client}%"))
    d, t = F.col("date_token"), F.col("time_token")
    stamp = F.concat(
        F.substring(d, 5, 2), F.lit("/"), F.right(d, F.lit(2)), F.lit("/"), F.left(d, F.lit(4)), F.lit(" "),
        F.left(t, F.lit(2)), F.lit(":"), F.substring(t, 3, 2), F.lit(":"), F.right(t, F.lit(2)),
    )
    gap = tx.CRLF + tx.CRLF
    body = F.concat(F.lit("DATE/TIME:\t"), stamp, F.lit(gap + "DESCRIPTION:\t"), F.col("description"), F.lit(gap + "COMMENT:\t(None)" + gap + "JOB RUN:\t(None)"))
    return rows.select("server_name", "event_id", body.alias("body"))


def reset_drive_state(samples: DataFrame) -> DataFrame:
    """State rows that make the next check of every drive alert: amount -1, an old alert time."""
    return samples.select(*DRIVE).distinct().select(
        *DRIVE, F.lit(-1).alias("last_amount_mb"), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("last_alert")
    )


def free_space_updates(
    samples: DataFrame, *, threshold_mb: int = 1024, repeat_minutes: int = 15, resets: DataFrame | None = None
) -> DataFrame:
    """Low samples with the flag whether they update the state of their drive.

    A low sample updates the state when its amount differs from the low sample
    before it or when the last update is more than the repeat time ago.  So a run
    of equal amounts is a throttle of its own that restarts with the run.
    ``resets`` (server_name, drive, sample_time) forces the next one to update.
    """
    low = samples.where(F.col("mb_free") < threshold_mb).select(*DRIVE, "sample_time", "mb_free")
    rows = low.withColumn("_order", F.lit(1))
    if resets is not None:
        rows = rows.unionByName(resets.select(*DRIVE, "sample_time", F.lit(-1).alias("mb_free"), F.lit(0).alias("_order")))
    rows = latest_so_far(rows, DRIVE, "sample_time", "mb_free", "_before", ties=["_order"], strict=True, block="DAY")
    # a reset sorts before the sample of its instant; the first sample of a drive
    # meets the seeded state, whose amount fits no sample
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("mb_free"))
    rows = rows.where("_order = 1").withColumn("_start", F.when(changed, F.col("sample_time")))
    rows = latest_so_far(rows, DRIVE, "sample_time", "_start", "_run", block="DAY")
    rows = cut(rows.select(
        *DRIVE, "sample_time", "mb_free",
        F.unix_micros(F.col("sample_time").cast("timestamp")).alias("_at"),
        F.unix_micros(F.col("_run").cast("timestamp")).alias("_run_at"),
        F.lit(repeat_minutes * 60_000_000 + 1).cast("bigint").alias("_delay_us"),
    ))
    hits = throttle(rows, [*DRIVE, "_run_at"], "_at", "_delay_us").withColumn("_hit", F.lit(True))
    return rows.join(hits, [*DRIVE, "_run_at", "_at"], "left").select(
        *DRIVE, "sample_time", "mb_free", F.coalesce("_hit", F.lit(False)).alias("updated")
    )


def free_space_messages(updates: DataFrame) -> DataFrame:
    """One alert per check with low drives: 17 when any state was updated, else 16.

    The message lists the low drives of the check; a server has few of them.
    """
    line = F.concat(F.col("drive"), F.lit(":\t"), F.col("mb_free").cast("string"), F.lit(" MB" + tx.CRLF))
    lines = F.array_sort(F.collect_list(F.struct("drive", line.alias("line"))))
    return updates.groupBy("server_name", "sample_time").agg(
        F.when(F.max("updated"), F.lit(17)).otherwise(F.lit(16)).alias("severity"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("drives"),
    ).select(
        "server_name", "sample_time", "severity",
        F.concat(F.lit("Warning: one or more disk drives is running out of free space:" + tx.CRLF), F.col("drives")).alias("message"),
    )


def free_space_alerts(
    samples: DataFrame, *, threshold_mb: int = 1024, repeat_minutes: int = 15, resets: DataFrame | None = None
) -> DataFrame:
    """Free-space alerts of a history of samples; one sample time is one check."""
    return free_space_messages(
        free_space_updates(samples, threshold_mb=threshold_mb, repeat_minutes=repeat_minutes, resets=resets)
    )


def growth_triggered_samples(growth: DataFrame, samples: DataFrame) -> DataFrame:
    """The latest sample of every drive of a server at each of its growth events."""
    drives = samples.select(*DRIVE).distinct()
    checks = growth.select("server_name", F.col("post_time").alias("check_time")).distinct().join(drives, "server_name")
    found = asof_latest(samples, checks, DRIVE, "sample_time", "check_time", ["mb_free"], block="DAY")
    return found.where(F.col("asof").isNotNull()).select(
        *DRIVE, F.col("check_time").alias("sample_time"), F.col("asof.mb_free").alias("mb_free")
    )


def volume_low_space(volumes: DataFrame, *, percent: int = 10, gigabytes: int = 10) -> DataFrame:
    """Distinct low volumes per server and the message that lists them in drive order."""
    mb = 1048576
    sized = volumes.select(
        "server_name", F.col("volume_mount_point").alias("drive"),
        int_div(F.col("total_bytes"), mb).cast("int").alias("total_mb"),
        int_div(F.col("available_bytes"), mb).cast("int").alias("free_mb"),
        int_div(F.col("available_bytes") * 100, F.col("total_bytes")).cast("int").alias("free_pct"),
    ).distinct()
    low = sized.where((F.col("free_pct") <= percent) | (F.col("free_mb") <= gigabytes * 1024))
    head = f"The following drives have less than {percent}% free space or less than {gigabytes} GB free space (or both):" + tx.CRLF
    names = F.array_join(F.sort_array(F.collect_set("drive")), tx.CRLF)
    message = low.groupBy("server_name").agg(F.concat(F.lit(head), names, F.lit(tx.CRLF)).alias("message"))
    return low.join(message, "server_name")


def counter_snapshot(counters: DataFrame) -> DataFrame:
    """Rows of the page-read counter with the seconds since start, to append."""
    return counters.where(
        F.col("counter_object").like("%Buffer Manager%") & (F.col("counter_name") == "Page reads/sec")
    ).select(
        "server_name", F.col("ts").alias("sample_time"),
        seconds_between(F.col("start_time"), F.col("ts")).alias("seconds_since_startup"), "pages_read_since_startup",
    )


def allowlist_check(services: DataFrame, *, engine_allowed: str, agent_allowed: str) -> DataFrame:
    """Service logins off their list, with the login to change back to.

    An unknown (NULL) login gives no finding; an empty one does.
    """
    engine_bad = ~tx.listed_in_csv(F.col("engine_login"), engine_allowed)
    agent_bad = ~tx.listed_in_csv(F.col("agent_login"), agent_allowed)

    def advice(service: str, login: str, allowed: str, bad: Column) -> Column:
        first = allowed.split(",")[0]
        text = F.concat(
            F.lit(f'The login of the {service} service was changed to "'), F.col(login),
            F.lit(f'". Please change it back to "{first}" and restart the service.'),
        )
        return F.when(bad, text)

    return services.select(
        "server_id", "engine_login", "agent_login",
        advice("engine", "engine_login", engine_allowed, engine_bad).alias("engine_finding"),
        advice("agent", "agent_login", agent_allowed, agent_bad).alias("agent_finding"),
    ).where(F.col("engine_finding").isNotNull() | F.col("agent_finding").isNotNull())


def benign_wait_filter(waits: DataFrame) -> DataFrame:
    """Wait totals per server and type without the idle wait types."""
    return (
        waits.where(~F.col("wait_type").isin(*BENIGN_WAITS))
        .groupBy("server_name", "wait_type").agg(F.sum("wait_ms").alias("wait_ms"), F.count("*").alias("samples"))
    )
