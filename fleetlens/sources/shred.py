"""Readers that turn event XML into typed columns.

Every document is parsed once by ``from_xml`` with a fixed schema; columns come
out of the struct.  Bad XML gives NULL fields, a missing node gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.joins import reduced_side
from fleetlens.functions.numbers import int_div, round_to_minute
from fleetlens.sources import schemas as s

# blanks inside statement text matter
_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def parse(xml: Column | str, schema: T.StructType, **options: str) -> Column:
    return F.from_xml(xml, schema, {**_OPTIONS, **options})


def with_document(df: DataFrame, xml: str, schema: T.StructType, **options: str) -> DataFrame:
    """Add the parsed document as ``_doc``, parsed exactly once per row.

    A filter on parsed fields would otherwise be pushed below the projection and
    parse the text a second time; a one-element ``explode`` keeps it above.
    """
    return df.select("*", F.explode(F.array(parse(xml, schema, **options))).alias("_doc"))


def cast_to(text: Column, kind: str) -> Column:
    """Typed value of an attribute text; NULL when it does not fit."""
    if kind == "string":
        return text
    if kind == "timestamp":
        # the wall clock of the document, whatever the session's time zone
        return text.try_cast("timestamp_ntz")
    return text.try_cast(kind)


def blocked_process_shred(reports: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Blocked-process reports as 8 base, 21 blocker and 31 victim columns.

    ``databases`` (server_name, database_id, database_name) gives the name; the
    post time is rounded to the minute, the duration goes from µs to ms.  The databases are measured
    first: a join that the size of their source decides would deal all reports to tasks by database.
    """
    doc = with_document(reports, "text_data", s.BLOCKED_PROCESS)
    if databases is not None:
        doc = doc.join(reduced_side(databases), ["server_name", "database_id"], "left")
    else:
        doc = doc.withColumn("database_name", F.lit(None).cast("string"))

    report = F.col("_doc")["blocked-process-report"]

    def side(path: str, fields: dict[str, str], prefix: str) -> list[Column]:
        process = report[path]["process"]
        columns = [cast_to(process[f"_{n}"], kind).alias(f"{prefix}_{n.lower()}") for n, kind in fields.items()]
        return [*columns, process["inputbuf"].alias(f"{prefix}_inputbuf")]

    return doc.select(
        "blocked_process_id", round_to_minute(F.col("post_time")).alias("post_time"), "database_name",
        int_div(F.col("duration_us"), 1000).alias("duration_ms"), "index_id", "is_system", "server_name",
        "session_login_name", "text_data",
        cast_to(report["_monitorLoop"], "bigint").alias("monitor_loop"),
        *side("blocking-process", s.BLOCKER_FIELDS, "blk"),
        *side("blocked-process", s.VICTIM_FIELDS, "vic"),
    )


def blocked_edges(reports: DataFrame) -> DataFrame:
    """Only the columns the blocking-chain report needs.

    The schema given to the parser is cut to them, so the other attributes are
    skipped instead of built.
    """
    def only(name: str) -> T.StructField:
        process = T.StructType([T.StructField("_spid", T.StringType())])
        return T.StructField(name, T.StructType([T.StructField("process", process)]))

    schema = T.StructType([T.StructField("blocked-process-report", T.StructType([
        T.StructField("_monitorLoop", T.StringType()), only("blocked-process"), only("blocking-process"),
    ]))])
    report = F.col("_doc")["blocked-process-report"]
    return with_document(reports, "text_data", schema).select(
        "server_name", "blocked_process_id", "post_time",
        cast_to(report["_monitorLoop"], "bigint").alias("monitor_loop"),
        cast_to(report["blocking-process"]["process"]["_spid"], "bigint").alias("blk_spid"),
        cast_to(report["blocked-process"]["process"]["_spid"], "bigint").alias("vic_spid"),
        int_div(F.col("duration_us"), 1000).alias("duration_ms"),
    )


def _named(nodes: Column, name: str, part: str) -> Column:
    """Value or text of the first node with a name; NULL when there is none."""
    return F.get(F.filter(nodes, lambda n: n["_name"] == name), F.lit(0))[part]


# field -> (node list, node name, child, type)
# (fixed values: the fields of an error event document)
ERROR_FIELDS = {
    "category": ("data", "text", "string"), "client_app_name": ("action", "value", "string"),
    "client_hostname": ("action", "value", "string"), "database_name": ("action", "value", "string"),
    "destination": ("data", "text", "string"), "error": ("data", "value", "bigint"),
    "error_number": ("data", "value", "int"), "file": ("data", "value", "string"),
    "function": ("data", "value", "string"), "is_intercepted": ("data", "value", "boolean"),
    "line": ("data", "value", "bigint"), "message": ("data", "value", "string"),
    "server_principal_name": ("action", "value", "string"), "severity": ("data", "value", "int"),
    "sql_text": ("action", "value", "string"), "state": ("data", "value", "int"),
    "user_defined": ("data", "value", "boolean"), "username": ("action", "value", "string"),
}


def error_event_shred(events: DataFrame) -> DataFrame:
    """Error event documents as 19 typed columns."""
    doc = with_document(events, "event_data", s.EVENT)
    columns = [cast_to(F.col("_doc._timestamp"), "timestamp").alias("timestamp")]
    for name, (nodes, child, kind) in ERROR_FIELDS.items():
        columns.append(cast_to(_named(F.col(f"_doc.{nodes}"), name, child), kind).alias(name))
    keep = [c for c in ("server_name", "event_id") if c in events.columns]
    return doc.select(*keep, "object_name", *columns)


def ring_buffer_explode(buffers: DataFrame) -> DataFrame:
    """Events of ring-buffer documents as 12 typed columns."""
    event = parse("target_data", s.RING_BUFFER)["event"]
    rows = buffers.select("server_name", F.explode(event).alias("e"))
    data, action = F.col("e.data"), F.col("e.action")
    return rows.select(
        "server_name",
        cast_to(_named(action, "session_id", "value"), "int").alias("session_id"),
        F.col("e._name").alias("event_name"),
        cast_to(F.col("e._timestamp"), "timestamp").alias("event_time"),
        cast_to(_named(data, "error_number", "value"), "int").alias("error_number"),
        cast_to(_named(data, "severity", "value"), "int").alias("severity"),
        _named(data, "state", "value").alias("state"),
        _named(data, "user_defined", "value").alias("user_defined"),
        _named(data, "category", "text").alias("category"),
        _named(data, "destination", "text").alias("destination"),
        _named(data, "is_intercepted", "value").alias("is_intercepted"),
        _named(data, "message", "value").alias("message"),
        _named(action, "sql_text", "value").alias("sql_text"),
    )


def deadlock_shred(events: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """First two processes of each deadlock report, victim first.

    The event time is moved from UTC into ``zone``, daylight saving included.  A
    report with one process leaves the second side NULL.
    """
    doc = with_document(events, "event_data", s.DEADLOCK)
    report = F.get(F.filter(F.col("_doc.data"), lambda n: n["_name"] == "xml_report"), F.lit(0))
    process = report["value"]["deadlock"]["process-list"]["process"]

    def side(i: int, suffix: str) -> list[Column]:
        p = F.get(process, F.lit(i))
        return [
            cast_to(p["_spid"], "bigint").alias(f"spid_{suffix}"), p["_clientapp"].alias(f"clientapp_{suffix}"),
            p["_hostname"].alias(f"hostname_{suffix}"), p["_loginname"].alias(f"loginname_{suffix}"),
            p["inputbuf"].alias(f"inputbuf_{suffix}"),
        ]

    at = F.convert_timezone(F.lit("UTC"), F.lit(zone), cast_to(F.col("_doc._timestamp"), "timestamp"))
    return doc.select(
        "server_name", "event_id", "object_name", at.alias("timestamp"), deadlock_xml(F.col("event_data")).alias("xml_deadlock_report"),
        *side(0, "vic"), *side(1, "win"),
    )


def deadlock_xml(event_data: Column) -> Column:
    """The deadlock element of the event as text; NULL when there is none."""
    return F.nullif(F.regexp_extract(event_data, r"(?s)<deadlock>.*?</deadlock>|<deadlock\s.*?</deadlock>", 0), F.lit(""))


def server_event_shred(messages: DataFrame) -> DataFrame:
    """Server and DDL events as flat columns; unreadable documents keep ``corrupt``."""
    doc = with_document(messages, "message_body", s.SERVER_EVENT, columnNameOfCorruptRecord="_corrupt")
    e = F.col("_doc")
    return doc.select(
        *[c for c in messages.columns if c not in ("message_body", "server_name")],
        F.coalesce(F.col("server_name"), e["ServerName"]).alias("server_name"),
        e["EventType"].alias("event_type"), e["LoginName"].alias("login_name"),
        e["DatabaseName"].alias("database_name"), e["SchemaName"].alias("schema_name"),
        e["ObjectName"].alias("object_name"), e["TargetObjectType"].alias("target_object_type"),
        e["RoleName"].alias("role_name"),
        F.coalesce(e["TSQLCommand"]["CommandText"], e["TextData"]).alias("command_text"),
        cast_to(e["Success"], "int").alias("success"), cast_to(e["IsSystem"], "int").alias("is_system"),
        cast_to(e["EventSubClass"], "int").alias("event_subclass"),
        (e.isNull() | e["_corrupt"].isNotNull() | e["EventType"].isNull()).alias("corrupt"),
        "message_body", e.alias("event"),
    )
