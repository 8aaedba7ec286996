"""Explicit schemas of the XML and JSON documents; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# attribute name -> type, as the blocked-process document writes them
# (fixed values: names of the document format)
BLOCKER_FIELDS = {
    "status": "string", "spid": "bigint", "sbid": "bigint", "ecid": "bigint", "priority": "bigint",
    "trancount": "bigint", "lastbatchstarted": "timestamp", "lastbatchcompleted": "timestamp",
    "lastattention": "string", "clientapp": "string", "hostname": "string", "hostpid": "bigint",
    "loginname": "string", "isolationlevel": "string", "xactid": "bigint", "currentdb": "bigint",
    "currentdbname": "string", "lockTimeout": "bigint", "clientoption1": "bigint", "clientoption2": "bigint",
}
VICTIM_FIELDS = {
    "taskpriority": "bigint", "logused": "bigint", "waitresource": "string", "waittime": "bigint",
    "ownerId": "bigint", "transactionname": "string", "lasttranstarted": "timestamp", "XDES": "string",
    "lockMode": "string", "schedulerid": "bigint", "kpid": "bigint", "status": "string", "spid": "bigint",
    "sbid": "bigint", "ecid": "bigint", "priority": "bigint", "trancount": "bigint",
    "lastbatchstarted": "timestamp", "lastbatchcompleted": "timestamp", "lastattention": "string",
    "clientapp": "string", "hostname": "string", "hostpid": "bigint", "loginname": "string",
    "isolationlevel": "string", "xactid": "bigint", "currentdb": "bigint", "lockTimeout": "bigint",
    "clientoption1": "bigint", "clientoption2": "bigint",
}


def _process(fields: dict[str, str]) -> T.StructType:
    # attributes are read as text and cast afterwards, so that one bad value is
    # NULL on its own and does not spoil the document
    attributes = [T.StructField(f"_{n}", T.StringType()) for n in fields]
    return T.StructType([
        T.StructField("process", T.StructType([*attributes, T.StructField("inputbuf", T.StringType())]))
    ])


BLOCKED_PROCESS = T.StructType([
    T.StructField("blocked-process-report", T.StructType([
        T.StructField("_monitorLoop", T.StringType()),
        T.StructField("blocked-process", _process(VICTIM_FIELDS)),
        T.StructField("blocking-process", _process(BLOCKER_FIELDS)),
    ]))
])

_NODE = T.ArrayType(T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("text", T.StringType()),
]))

EVENT = T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("_timestamp", T.StringType()),
    T.StructField("data", _NODE),
    T.StructField("action", _NODE),
])

RING_BUFFER = T.StructType([
    T.StructField("_totalEventsProcessed", T.StringType()),
    T.StructField("event", T.ArrayType(EVENT)),
])

DEADLOCK = T.StructType([
    T.StructField("_timestamp", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("_name", T.StringType()),
        T.StructField("value", T.StructType([
            T.StructField("deadlock", T.StructType([
                T.StructField("process-list", T.StructType([
                    T.StructField("process", T.ArrayType(T.StructType([
                        T.StructField("_spid", T.StringType()),
                        T.StructField("_clientapp", T.StringType()),
                        T.StructField("_hostname", T.StringType()),
                        T.StructField("_loginname", T.StringType()),
                        T.StructField("inputbuf", T.StringType()),
                    ])))
                ]))
            ]))
        ])),
    ]))),
])

# children of a server or DDL event, in document order
# (fixed values: names of the document format)
SERVER_EVENT_FIELDS = (
    "EventType", "PostTime", "ServerName", "LoginName", "DatabaseName", "SchemaName", "ObjectName",
    "TargetObjectType", "RoleName", "TextData", "EventSubClass", "Success", "IsSystem",
)
SERVER_EVENT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in SERVER_EVENT_FIELDS],
    T.StructField("TSQLCommand", T.StructType([T.StructField("CommandText", T.StringType())])),
    T.StructField("_corrupt", T.StringType()),
])

ASSESSMENT = T.StructType([
    T.StructField("Databases", T.ArrayType(T.StructType([
        T.StructField("Name", T.StringType()),
        T.StructField("CompatibilityLevel", T.StringType()),
        T.StructField("AssessmentRecommendations", T.ArrayType(T.StructType([
            T.StructField("CompatibilityLevel", T.StringType()),
            T.StructField("Category", T.StringType()),
            T.StructField("Severity", T.StringType()),
            T.StructField("ChangeCategory", T.StringType()),
            T.StructField("Title", T.StringType()),
            T.StructField("Impact", T.StringType()),
            T.StructField("Recommendation", T.StringType()),
            T.StructField("MoreInfo", T.StringType()),
            T.StructField("ImpactedObjects", T.ArrayType(T.StructType([
                T.StructField("ObjectType", T.StringType()),
                T.StructField("Name", T.StringType()),
                T.StructField("ImpactDetail", T.StringType()),
            ]))),
        ]))),
    ])))
])
