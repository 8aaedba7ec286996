"""Instance configuration, drift reports and snapshot names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx

DB = ["server_name", "database_name"]
# fixed values: names of the configuration items
CONFIG_ITEMS = (
    "Backup To Disk", "Backup File Keep Days", "Available Disk Space Threshold", "domain DBA Team Operator Name",
    "domain DBA Team Operator Email", "Backup Path - FULL", "Backup Path - DIFFERENTIAL", "Backup Path - LOG",
    "Backup History Keep Days", "Job History Keep Days", "Allow ALTER DATABASE", "ALTER DATABASE - Allowed Logins",
    "ALTER DATABASE - Temporary Allowed Logins", "Allow DROP DATABASE", "DROP DATABASE - Allowed Logins",
    "Allow Risky Server Roles", "ADD SERVER ROLE - Allowed Logins", "Allow Risky Database Roles",
    "sp_addrolemember - Allowed Logins", "Database Mail Address", "Database Mail Display Name",
    "Database Mail Reply To Address", "Database Mail Address - Default", "Database Mail Display Name - Default",
    "Database Mail Reply To Address - Default", "Database Mail Address - DBA", "Database Mail Display Name - DBA",
    "Database Mail Reply To Address - DBA", "Database Mail Address - Security", "Database Mail Display Name - Security",
    "Database Mail Reply To Address - Security", "Database Mail Server", "Database Mail Anonymous Authentication",
    "Alert Backup/Restore", "Alert Startup", "Alert Service Login Changed", "SQL DB Engine Login", "SQL Agent Login",
    "Alert [sa] Login", "Trace Flags", "Cloned Server Check", "Alert DB Owner Changed", "Alert DBCC Command Issued",
    "Audit Security Events", "Alert Security Events", "Backup To Disk - Archive", "Backup Path - Archive",
    "Alert Instance Altered", "Backup Retention Period Expression", "Backup WITH ENCRYPTION",
    "Backup Encryption - Server Certificate", "Alert Missing Backup Files",
)
# the item that may stay empty
OPTIONAL_ITEM = "ALTER DATABASE - Temporary Allowed Logins"


# fixed values: what an item is set to where a site says nothing else; {login}, {team}, {mail}, {host}, {domain},
# {server} and {address} are filled in
_YES = (
    "Backup To Disk", "Database Mail Anonymous Authentication", "Alert Backup/Restore", "Alert Startup", "Alert Service Login Changed",
    "Alert [sa] Login", "Cloned Server Check", "Alert DB Owner Changed", "Alert DBCC Command Issued", "Audit Security Events",
    "Alert Security Events", "Backup To Disk - Archive", "Alert Instance Altered", "Alert Missing Backup Files",
)
_NO = ("Allow ALTER DATABASE", "Allow DROP DATABASE", "Allow Risky Server Roles", "Allow Risky Database Roles")
_LOGIN_LISTS = (
    "ALTER DATABASE - Allowed Logins", "DROP DATABASE - Allowed Logins", "ADD SERVER ROLE - Allowed Logins", "sp_addrolemember - Allowed Logins",
)
_FOLDERS = {"FULL": "Full", "DIFFERENTIAL": "Differential", "LOG": "Trx Log", "Archive": "Archive"}
CONFIG_DEFAULTS = {
    **dict.fromkeys(_YES, "1"), **dict.fromkeys(_NO, "0"), **dict.fromkeys(_LOGIN_LISTS, "{login}"),
    **{f"Backup Path - {kind}": "\\\\{address}\\Backup Path\\{domain}\\{server}\\" + folder for kind, folder in _FOLDERS.items()},
    **{f"Database Mail Address{profile}": "{mail}" for profile in ("", " - Default", " - DBA", " - Security")},
    **{f"Database Mail Display Name{profile}": "{team}" for profile in ("", " - Default", " - DBA", " - Security")},
    **{f"Database Mail Reply To Address{profile}": "{mail}" for profile in ("", " - Default", " - DBA", " - Security")},
    "Backup File Keep Days": "27", "Available Disk Space Threshold": "2048", "Backup History Keep Days": "1120", "Job History Keep Days": "370",
    "domain DBA Team Operator Name": "{team}", "domain DBA Team Operator Email": "{mail}", "Database Mail Server": "{host}",
    "SQL DB Engine Login": "{login}", "SQL Agent Login": "{login}", "Trace Flags": "1118, 3226, 2371",
    "Backup Retention Period Expression": "DATEADD(wk, -14, CURRENT_TIMESTAMP)", "Backup WITH ENCRYPTION": "{encryption}",
    "Backup Encryption - Server Certificate": "{certificate}",
}
_FLAG = "(BIT) 1 = yes, 0 = no. "


def describe(item: str) -> str:
    """What an item means, in words; the kind of its value first."""
    special = {
        "Backup File Keep Days": "(INT) Days that backup files stay on disk.", "Available Disk Space Threshold": "(INT) Free megabytes of a drive below which an alert is sent.",
        "Backup History Keep Days": "(INT) Days that backup history is kept.", "Job History Keep Days": "(INT) Days that job history is kept.",
        "domain DBA Team Operator Name": "Operator that stands for the DBA team.", "domain DBA Team Operator Email": "Mail addresses of that operator, separated by semicolons.",
        "Trace Flags": "csv list of the trace flags set at every start.", "Backup Retention Period Expression": "Expression of the time from which backup files are kept, archives excepted.",
        "Backup Encryption - Server Certificate": "Certificate that encrypts backups.", "Database Mail Server": "Name or address of the mail server.",
        "SQL DB Engine Login": "Logins of the engine service, with variations.", "SQL Agent Login": "Logins of the agent service, with variations.",
    }
    if item in special:
        return special[item]
    if item.startswith("Backup Path - "):
        return f"Path where {item.removeprefix('Backup Path - ')} backups are written."
    if item.endswith("Allowed Logins"):
        return f"csv list of logins that may use {item.split(' - ')[0]}" + (" for a time." if "Temporary" in item else ".")
    if item.startswith("Database Mail") and item in CONFIG_DEFAULTS and CONFIG_DEFAULTS[item] != "1":
        field, _, profile = item.removeprefix("Database Mail ").partition(" - ")
        return f"{field} of the mail account {profile or 'without a profile'}."
    return _FLAG + item


def config_items(items: tuple[str, ...] = CONFIG_ITEMS, defaults: dict[str, str] = CONFIG_DEFAULTS) -> list[tuple[str, str, str | None]]:
    """(name, description, default) of every item; a default may hold names in braces."""
    return [(i, describe(i), defaults.get(i)) for i in items]


def config_seed(config: DataFrame, servers: DataFrame, *, items: tuple[str, ...] = CONFIG_ITEMS) -> DataFrame:
    """The configuration with the items each server still lacks, as empty values, all with their description.

    The item list is short; every server row is exploded over its distinct names.  Items off
    the list keep their rows and have no description.
    """
    names = F.array_distinct(F.array(*[F.lit(i) for i in items]))
    wanted = servers.select("server_id").distinct().select("server_id", F.explode(names).alias("name"))
    missing = wanted.join(config, ["server_id", "name"], "left_anti").withColumn("value", F.lit(""))
    words = F.create_map(*[F.lit(x) for i in dict.fromkeys(items) for x in (i, describe(i))])
    return config.unionByName(missing).withColumn("description", words[F.col("name")])


def config_fill(config: DataFrame, servers: DataFrame, *, site: dict[str, str], defaults: dict[str, str] = CONFIG_DEFAULTS) -> DataFrame:
    """Empty values take the default of their item, others stay.

    ``servers`` (server_id and one column for each name in braces that depends on the server) and
    ``site`` (the other names) fill the braces of a default; a null there leaves the value empty.
    The item of temporary logins has no default, so that a value set elsewhere is not lost.
    """
    default = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])[F.col("name")]
    own = [c for c in servers.columns if c != "server_id"]
    facts = servers.groupBy("server_id").agg(*[F.max(F.col(c).cast("string")).alias(f"_{c}") for c in own])
    for name, value in [*[(c, F.col(f"_{c}")) for c in own], *[(k, F.lit(v)) for k, v in site.items()]]:
        mark = F.lit("{" + name + "}")
        default = F.replace(default, mark, F.coalesce(value, mark))
    empty = F.col("value").isNull() | (F.col("value") == "")
    known = config.join(facts, "server_id", "left").withColumn("_default", default)
    # a name that is not known is still in braces
    usable = F.nullif(F.regexp_replace("_default", r"^.*\{\w+\}.*$", ""), F.lit(""))
    return known.withColumn("value", F.when(empty, F.coalesce(usable, F.col("value"))).otherwise(F.col("value"))).select(*config.columns)


def config_gaps(config: DataFrame, *, optional: tuple[str, ...] = (OPTIONAL_ITEM,)) -> DataFrame:
    """Items that are still empty and must not be; a valid configuration gives no row."""
    return config.where((F.coalesce("value", F.lit("")) == "") & ~F.col("name").isin(*optional))


def config_lookup(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Value per request (server_id, name), empty when there is none."""
    return requests.join(config, ["server_id", "name"], "left").select(
        *requests.columns, F.coalesce("value", F.lit("")).alias("value")
    )


def config_drift(settings: DataFrame) -> DataFrame:
    """Settings that are off their desired value or bound, with the value to set."""
    name, value = F.col("setting_name"), F.col("setting_value")
    special = F.col("server_name").like("%-OS")
    # fixed values: desired state of the server settings
    desired = (
        F.when((name == "show advanced options") & ~value.eqNullSafe(F.lit(1)), F.lit(1))
        .when((name == "fill factor (%)") & ~value.eqNullSafe(F.lit(0)), F.lit(0))
        .when((name == "max degree of parallelism") & (value == 1), F.lit(0))
        .when((name == "cost threshold for parallelism") & (value < 25), F.lit(25))
        .when((name == "optimize for ad hoc workloads") & special & (value == 0), F.lit(1))
        .when((name == "remote admin connections") & (value == 0), F.lit(1))
        .when((name == "backup compression default") & (value.isNull() | (value == 0)), F.lit(1))
    )
    return settings.select("server_name", "setting_name", "setting_value", desired.alias("desired_value")).where(
        F.col("desired_value").isNotNull()
    )


def database_setting_drift(databases: DataFrame, *, own_database: str = "DbaData") -> DataFrame:
    """Databases off the page-verify or recovery-model standard, with the fix text."""
    name = tx.quotename("database_name")
    simple = (
        (F.col("recovery_model_desc") == "SIMPLE") & ~F.col("database_name").isin("master", "tempdb", "msdb", own_database)
        & ~F.col("database_name").like("ReportServer%TempDB")
    )
    fixes = F.array_compact(F.array(
        F.when(F.col("page_verify_option_desc") != "CHECKSUM", F.struct(
            F.lit("page verify").alias("setting"), F.concat(F.lit("ALTER DATABASE "), name, F.lit(" SET PAGE_VERIFY CHECKSUM  WITH NO_WAIT;")).alias("command"))),
        F.when(simple, F.struct(
            F.lit("recovery model").alias("setting"), F.concat(F.lit("ALTER DATABASE "), name, F.lit(" SET RECOVERY FULL WITH NO_WAIT;")).alias("command"))),
    ))
    return databases.select(*DB, F.inline(fixes))


def network_segment_map(addresses: DataFrame, rules: dict[str, str], *, default: str) -> DataFrame:
    """Target host of the first three octets of an address; the longest prefix wins.

    A target that starts with a dot is appended to the segment, any other replaces
    it.  A missing address gives an empty segment.
    """
    address = F.col("local_net_address")
    segment = F.coalesce(
        F.concat(tx.parsename(address, 4), F.lit("."), tx.parsename(address, 3), F.lit("."), tx.parsename(address, 2)), F.lit("")
    )

    def target(host: str) -> Column:
        return F.concat(F.col("segment"), F.lit(host)) if host.startswith(".") else F.lit(host)

    out = target(default)
    for prefix in sorted(rules, key=len):
        out = F.when(F.col("segment").startswith(prefix), target(rules[prefix])).otherwise(out)
    return addresses.withColumn("segment", segment).withColumn("target_host", out)


def snapshot_suffix(now: Column) -> Column:
    """Date of ``now`` and its time rounded to ten minutes.

    Only the time is rounded: four minutes before midnight give today and 0000.
    """
    ten = F.floor((F.unix_seconds(now.cast("timestamp")) + 300) / 600) * 600
    return F.concat(F.date_format(now, "yyyyMMdd"), F.lit("_"), F.date_format(F.timestamp_seconds(ten).cast("timestamp_ntz"), "HHmm"))


def snapshot_names(files: DataFrame, databases: DataFrame, *, now: Column, data_path: str) -> DataFrame:
    """CREATE SNAPSHOT text per online database that is no snapshot, logs left out.

    A database has a bounded number of files, which form one text in file order.
    """
    ready = databases.where((F.col("state_desc") == "ONLINE") & F.col("source_database_guid").isNull()).select(*DB)
    snapshot = F.concat(F.col("database_name"), F.lit("_"), snapshot_suffix(now))
    item = F.concat(
        F.lit("(Name = '"), F.col("logical_name"), F.lit("', FILENAME = '" + tx.with_backslash(data_path)), F.col("snapshot_name"),
        F.lit("."), F.col("file_id").cast("string"), F.lit(".snp')"),
    )
    listed = F.array_sort(F.collect_list(F.struct("file_id", item.alias("item"))))
    return (
        files.where(F.col("type_desc") != "LOG").join(ready, DB, "left_semi").withColumn("snapshot_name", snapshot)
        .groupBy(*DB, "snapshot_name").agg(F.array_join(F.transform(listed, lambda x: x["item"]), ", ").alias("items"))
        .select(*DB, "snapshot_name", F.concat(
            F.lit("CREATE DATABASE "), tx.quotename("snapshot_name"), F.lit(" ON "), F.col("items"),
            F.lit(" AS SNAPSHOT OF "), tx.quotename("database_name"), F.lit(";"),
        ).alias("command"))
    )


def snapshot_xref(databases: DataFrame) -> DataFrame:
    """Snapshots with the name of their source, NULL when that is gone."""
    sources = databases.select("server_name", F.col("database_guid").alias("source_database_guid"), F.col("database_name").alias("source_database"))
    return (
        databases.where(F.col("source_database_guid").isNotNull())
        .select("server_name", F.col("database_name").alias("snapshot_database"), "source_database_guid")
        .join(sources, ["server_name", "source_database_guid"], "left")
        .select("server_name", "snapshot_database", "source_database")
    )
