"""Event handlers: each is a filter and a projection over shredded server events.

Every function takes the output of ``server_event_shred`` and works the same on a
batch and on a stream.  A lookup table joins as an ordinary stream-static join;
its size decides the join strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.operators.events import event_to_html

# logins whose backups, restores and console commands need no alert
TRUSTED = ("%DBA%", "%MSSqlAdmin%")

# fixed values: event names of the audited families
STATISTICS_EVENTS = ("CREATE_STATISTICS", "UPDATE_STATISTICS", "DROP_STATISTICS")
BROKER_EVENTS = (
    "ALTER_QUEUE", "CREATE_QUEUE", "DROP_QUEUE", "CREATE_CONTRACT", "DROP_CONTRACT",
    "CREATE_MESSAGE_TYPE", "DROP_MESSAGE_TYPE", "CREATE_SERVICE", "DROP_SERVICE",
)
SECURITY_FAMILIES = {
    "permission": ("GRANT_DATABASE", "DENY_DATABASE", "REVOKE_DATABASE"),
    "application role": ("CREATE_APPLICATION_ROLE", "ALTER_APPLICATION_ROLE", "DROP_APPLICATION_ROLE"),
    "user": ("CREATE_USER", "ALTER_USER", "DROP_USER"),
    "login": ("CREATE_LOGIN", "ALTER_LOGIN", "DROP_LOGIN"),
    "role": ("CREATE_ROLE", "ALTER_ROLE", "DROP_ROLE", "ADD_ROLE_MEMBER", "DROP_ROLE_MEMBER"),
    "server role": (
        "CREATE_SERVER_ROLE", "ALTER_SERVER_ROLE", "DROP_SERVER_ROLE",
        "ADD_SERVER_ROLE_MEMBER", "DROP_SERVER_ROLE_MEMBER",
    ),
}
RISKY_SERVER_ROLES = ("sysadmin", "serveradmin", "securityadmin", "diskadmin", "dbcreator")
RISKY_DATABASE_ROLES = ("db_owner", "db_accessadmin", "db_backupoperator", "db_securityadmin")
EXEMPT_MEMBERS = ("RSExecRole", "NT SERVICE\\ReportServer", "SchemaCreator")
# fixed values: forbidden forms of ALTER DATABASE and their messages; the first match wins
FORBIDDEN_CHANGES = {
    "%SET RECOVERY%": "Altering the RECOVERY model",
    "%MODIFY FILE%": "Altering database files",
    "%SET PAGE_VERIFY%": "Altering PAGE_VERIFY",
    "%SET AUTO_SHRINK%": "Altering AUTO_SHRINK",
    "%SET AUTO_CLOSE%": "Altering AUTO_CLOSE",
    "%SET AUTO_UPDATE_STATISTICS%": "Altering AUTO_UPDATE_STATISTICS (or AUTO_UPDATE_STATISTICS_ASYNC)",
    "%SET AUTO_CREATE_STATISTICS%": "Altering AUTO_CREATE_STATISTICS (or AUTO_CREATE_STATISTICS_ASYNC)",
}

ID = ["server_name", "event_id", "post_time"]


def _alert(events: DataFrame, subject: Column, reason: Column) -> DataFrame:
    """Alert rows; a reason leads the rendered event."""
    lead = F.when(reason.isNull(), F.lit("")).otherwise(F.concat(F.lit("<p>"), reason, F.lit("</p><br/>")))
    return events.select(
        *ID, subject.alias("subject"), reason.alias("reason"), F.concat(lead, event_to_html(F.col("message_body"))).alias("body")
    )


def _subject(text: Column | str) -> Column:
    return F.concat(F.col("server_name"), F.lit(" -- "), F.col(text) if isinstance(text, str) else text)


def _untrusted(trusted: tuple[str, ...]) -> Column:
    """True for logins off the list; NULL, so never an alert, for an unknown login."""
    return ~tx.ci_like_any(F.col("login_name"), trusted)


def _of(events: DataFrame, *types: str) -> DataFrame:
    return events.where(~F.col("corrupt") & F.col("event_type").isin(*types))


def good_events(events: DataFrame) -> DataFrame:
    return events.where(~F.col("corrupt"))


def quarantined_events(events: DataFrame) -> DataFrame:
    """Unreadable messages, kept apart so that they never block the rest."""
    return events.where("corrupt").select(*ID, "message_body")


def audit_append(events: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Audit rows (event name, document, time); a missing time becomes ``now``."""
    default = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return events.select(
        "server_name", "event_id", F.col("event_type").alias("event_name"),
        F.col("message_body").alias("event_data"), F.coalesce("post_time", default).alias("event_time"),
    )


def _restores(events: DataFrame, databases: DataFrame) -> DataFrame:
    state = databases.select("server_name", "database_name", F.col("state_desc").alias("_state"), F.lit(True).alias("_known"))
    return _of(events, "AUDIT_BACKUP_RESTORE_EVENT").join(state, ["server_name", "database_name"], "left")


def backup_restore_alerts(
    events: DataFrame, databases: DataFrame, *, trusted: tuple[str, ...] = TRUSTED
) -> DataFrame:
    """Backups and restores by untrusted logins, and restores that left no usable database.

    Subclass 1 and 3 are backups, 2 is a restore.  The database state is the
    snapshot given with the batch; see ``restores_to_recheck`` for the unfinished.
    """
    untrusted = F.coalesce(_untrusted(trusted), F.lit(False))
    backup = F.col("event_subclass").isin(1, 3) & untrusted
    restore = (F.col("event_subclass") == 2) & F.col("command_text").ilike("%RESTORE%DATABASE%")
    recovered = restore & ~F.col("command_text").ilike("%NORECOVERY%")
    state = F.upper("_state")
    problem = F.when(
        recovered,
        F.when(F.col("_known").isNull(), F.lit("Restored database no longer exists:"))
        .when(state.isin("OFFLINE", "RECOVERY PENDING", "SUSPECT", "EMERGENCY"), F.lit("Restored database is not ONLINE:"))
        .when(F.coalesce(state, F.lit("")) == "", F.lit("Database state is unknown:")),
    )
    rows = _restores(events, databases).withColumn("_problem", problem)
    wanted = rows.where(backup | (restore & (untrusted | F.col("_problem").isNotNull())))
    return _alert(wanted, _subject("event_type"), F.col("_problem"))


def restores_to_recheck(events: DataFrame, databases: DataFrame) -> DataFrame:
    """Restores whose database is still restoring: to be judged with a later snapshot."""
    return _restores(events, databases).where(
        (F.col("event_subclass") == 2) & F.col("command_text").ilike("%RESTORE%DATABASE%")
        & ~F.col("command_text").ilike("%NORECOVERY%") & F.upper("_state").isin("RESTORING", "RECOVERING")
    ).select(*ID, "database_name", "message_body")


def login_alerts(events: DataFrame, *, login: str = "sa") -> DataFrame:
    """Logins of one account, failed or succeeded."""
    rows = _of(events, "AUDIT_LOGIN", "AUDIT_LOGIN_FAILED").where(tx.ci_equals(F.col("login_name"), login))
    outcome = F.when(F.col("success") == 0, F.lit("Login Failed")).otherwise(F.lit("Login Succeeded"))
    return _alert(rows, F.concat(F.col("server_name"), F.lit(f" - [{login}] Login")), outcome)


def owner_change_alerts(events: DataFrame) -> DataFrame:
    rows = _of(events, "AUDIT_CHANGE_DATABASE_OWNER")
    return _alert(rows, _subject("event_type"), F.lit(None).cast("string"))


def dbcc_alerts(events: DataFrame, *, trusted: tuple[str, ...] = TRUSTED, system_login: str = "sa") -> DataFrame:
    """Successful console commands of untrusted logins, system activity left out."""
    rows = _of(events, "AUDIT_DBCC_EVENT").where(
        (F.col("success") == 1)
        & _untrusted(trusted)
        & ~F.col("command_text").ilike("%SHOW_STATISTICS%")
        & (~tx.ci_equals(F.col("login_name"), system_login) | (F.col("is_system") != 1))
    )
    return _alert(rows, _subject("event_type"), F.lit(None).cast("string"))


def deadlock_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with the deadlock text attached, and audit rows: one output each."""
    rows = _of(events, "DEADLOCK_GRAPH")
    alerts = rows.select(
        *ID, _subject("event_type").alias("subject"), event_to_html(F.col("message_body")).alias("body"),
        F.col("command_text").alias("attachment"),
    )
    return alerts, audit_append(rows)


def deprecation_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deprecation events outside msdb; an unknown database is left out."""
    rows = _of(events, "DEPRECATION_ANNOUNCEMENT", "DEPRECATION_FINAL_SUPPORT").where(
        F.lower("database_name") != "msdb"
    )
    return _alert(rows, _subject("event_type"), F.lit(None).cast("string")), audit_append(rows)


def growth_events(events: DataFrame) -> DataFrame:
    """Data and log file growth, used as the clock of the free-space check."""
    return _of(events, "DATA_FILE_AUTO_GROW", "LOG_FILE_AUTO_GROW")


def ddl_audit_log(events: DataFrame, objects: DataFrame, *, excluded_database: str = "SSISDB") -> DataFrame:
    """DDL events worth keeping, with their scope.

    ``objects`` (server_name, database_name, schema_name, object_name,
    is_ms_shipped) tells which objects the vendor ships.
    """
    command = F.coalesce("command_text", F.lit(""))
    rebuild = command.ilike("%REBUILD%") | command.ilike("%REORGANIZE%") | command.ilike("%DISABLE%")
    noise = (
        F.col("event_type").isin(*STATISTICS_EVENTS, *BROKER_EVENTS)
        | ((F.col("event_type") == "ALTER_INDEX") & rebuild)
        | ((F.col("event_type") == "ALTER_TABLE") & command.ilike("%SWITCH%PARTITION%"))
        | (F.coalesce("database_name", F.lit("")) == excluded_database)
    )
    key = ["server_name", "database_name", "schema_name", "object_name"]
    shipped = objects.where("is_ms_shipped = 1").select(*key).distinct().withColumn("_shipped", F.lit(True))
    scope = F.when(F.col("target_object_type") == "Server", F.lit("Server")).when(
        F.col("database_name") != "", F.lit("Database")
    )
    return (
        good_events(events).where(~noise)
        .join(shipped, key, "left")
        .where(F.col("_shipped").isNull())
        .select(
            "server_name", "event_id", F.col("event_type").alias("event_name"), scope.alias("scope"),
            F.col("post_time").alias("event_time"), F.col("message_body").alias("event_data"),
        )
    )


def security_ddl_audit(events: DataFrame, *, audit: bool = True, alert: bool = True) -> DataFrame:
    """Security events with their family, where they go, and their special handler."""
    family = F.lit(None).cast("string")
    for name, types in SECURITY_FAMILIES.items():
        family = F.when(F.col("event_type").isin(*types), F.lit(name)).otherwise(family)
    handler = F.when(F.col("event_type") == "ADD_SERVER_ROLE_MEMBER", F.lit("server role policy")).when(
        F.col("event_type") == "ADD_ROLE_MEMBER", F.lit("database role policy")
    )
    return (
        good_events(events).withColumn("family", family).where(F.col("family").isNotNull())
        .select(
            *ID, F.col("event_type").alias("event_name"), "family", F.lit(audit).alias("to_audit"),
            F.lit(alert).alias("to_alert"), handler.alias("handler"), F.col("message_body").alias("event_data"),
        )
    )


def role_policy_violations(
    events: DataFrame, *, allowed_logins: str = "", allow_risky: bool = False, instance: str = "", exact: bool = False
) -> DataFrame:
    """Members added to risky roles, with the statement that would undo it.

    The report server's own members and the schema role are exempt in databases.
    """
    server = F.col("event_type") == "ADD_SERVER_ROLE_MEMBER"
    exempt = (*EXEMPT_MEMBERS, f"NT SERVICE\\ReportServer${instance}")
    risky = (server & tx.ci_isin(F.col("role_name"), RISKY_SERVER_ROLES)) | (
        ~server & tx.ci_isin(F.col("role_name"), RISKY_DATABASE_ROLES) & ~tx.ci_isin(F.col("object_name"), exempt)
    )
    member = F.concat(F.lit("ROLE ["), F.col("role_name"), F.lit("] DROP MEMBER ["), F.col("object_name"), F.lit("]"))
    undo = F.when(server, F.concat(F.lit("ALTER SERVER "), member)).otherwise(
        F.concat(F.lit("["), F.col("database_name"), F.lit("]..sp_executesql N'ALTER "), member, F.lit("'"))
    )
    return (
        _of(events, "ADD_SERVER_ROLE_MEMBER", "ADD_ROLE_MEMBER")
        .where(F.lit(not allow_risky) & ~tx.listed_in_csv(F.col("login_name"), allowed_logins, exact=exact) & risky)
        .select(
            *ID, "login_name", "database_name", "role_name", "object_name",
            F.when(server, F.lit("server role")).otherwise(F.lit("database role")).alias("policy"), undo.alias("undo_command"),
        )
    )


def alter_database_policy(
    events: DataFrame,
    *,
    allowed_logins: str = "",
    temporary_logins: str = "",
    allow: bool = False,
    environment: str = "production",
) -> DataFrame:
    """Database changes by logins off the list; forbidden kinds are violations, with the statement."""
    kind = F.lit(None).cast("string")
    for pattern, what in reversed(FORBIDDEN_CHANGES.items()):
        text = F.lit(f"{what} is not permitted in {environment} environments." + tx.CRLF + tx.CRLF)
        kind = F.when(F.col("command_text").ilike(pattern), F.concat(text, F.col("command_text"))).otherwise(kind)
    excused = tx.listed_in_csv(F.col("login_name"), temporary_logins)
    return (
        _of(events, "ALTER_DATABASE")
        .where(F.lit(not allow) & ~tx.listed_in_csv(F.col("login_name"), allowed_logins))
        .select(
            *ID, "login_name", "command_text", F.concat(F.col("server_name"), F.lit(" - Database Altered")).alias("subject"),
            F.when(~excused, kind).alias("violation"), event_to_html(F.col("message_body")).alias("body"),
        )
    )


def drop_database_policy(
    events: DataFrame, *, allowed_logins: str = "", allow: bool = False, environment: str = "production"
) -> DataFrame:
    """Every drop attempt is an alert; a violation unless allowed or listed."""
    text = F.concat(
        F.lit(f"Dropping databases is not permitted in {environment} environments." + tx.CRLF + tx.CRLF + "TSql Command: "),
        F.col("command_text"), F.lit(tx.CRLF + "Login Name: "), F.col("login_name"),
    )
    barred = F.lit(not allow) & ~tx.listed_in_csv(F.col("login_name"), allowed_logins)
    return _of(events, "DROP_DATABASE").select(
        *ID, "login_name", F.concat(F.col("server_name"), F.lit(" - Database Dropped")).alias("subject"),
        F.when(barred, text).alias("violation"), event_to_html(F.col("message_body")).alias("body"),
    )


def instance_change_alerts(events: DataFrame, *, trusted: tuple[str, ...] = TRUSTED) -> DataFrame:
    """Setting changes by untrusted logins, and every new database."""
    altered = F.col("event_type") == "ALTER_INSTANCE"
    rows = _of(events, "ALTER_INSTANCE", "CREATE_DATABASE").where(~altered | _untrusted(trusted))
    what = F.when(altered, F.lit(" - Instance Altered")).otherwise(F.lit(" - Database Created"))
    return _alert(rows, F.concat(F.col("server_name"), what), F.lit(None).cast("string"))


def maintenance_window_filter(
    events: DataFrame, *, time_column: str = "post_time", day: str = "Sunday", opens: str = "00:00:00", closes: str = "17:00:00"
) -> DataFrame:
    """Drop notices that fall into the weekly maintenance window."""
    at = F.date_format(time_column, "HH:mm:ss.SSSSSS")
    inside = (F.date_format(time_column, "EEEE") == day) & at.between(f"{opens}.000000", f"{closes}.000000")
    return events.where(~inside)
