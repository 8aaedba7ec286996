"""Configuration, chains, documents, listings and small column helpers."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import numbers as nb
from fleetlens.functions import text as tx
from fleetlens.operators import config as c
from fleetlens.operators import indexes as ix
from fleetlens.operators import nested as n
from fleetlens.operators import queryplans as qp
from fleetlens.sources import files
from fleetlens.streaming import handlers as h


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_snapshot_suffix_rounds_only_the_time(spark):
    cases = {"2024-01-01 23:54:59": "20240101_2350", "2024-01-01 23:55:00": "20240101_0000", "2024-01-01 23:56:00": "20240101_0000", "2024-01-01 10:04:59": "20240101_1000"}
    for text, expected in cases.items():
        assert spark.range(1).select(c.snapshot_suffix(_ts(text))).first()[0] == expected


def test_number_helpers(spark):
    row = spark.range(1).select(
        nb.int_div(F.lit(-7), 2), nb.int_div(F.lit(7), 0), nb.minutes_between(_ts("2024-01-01 00:59:59"), _ts("2024-01-01 01:01:00")),
        nb.round_to_minute(_ts("2024-01-01 00:00:30")), tx.text_length(F.lit("ab  ")), tx.parsename(F.lit("a.b.c"), 3), tx.parsename(F.lit("a.b"), 3), tx.quotename(F.lit("a]b")),
    ).first()
    assert tuple(map(str, row)) == ("-3", "None", "2", "2024-01-01 00:01:00", "2", "a", "None", "[a]]b]")
    avg = spark.createDataFrame([(1,), (2,), (None,)], "x int").select(nb.int_avg(F.col("x"))).first()[0]
    assert avg == 1


def test_csv_list(spark):
    logins = spark.createDataFrame([("dom\\DBA",), ("dba",), ("",), (None,), ("other",)], "l string")
    loose = [r[0] for r in logins.select(tx.listed_in_csv(F.col("l"), "DOM\\dba, x")).collect()]
    exact = [r[0] for r in logins.select(tx.listed_in_csv(F.col("l"), "DOM\\dba, x", exact=True)).collect()]
    assert loose == [True, True, False, None, False]
    assert exact == [True, False, False, None, False]


def test_index_ddl(spark):
    texts = ["CREATE INDEX i ON t(a)", "create index i on t(a) with (PAD_INDEX = ON)", "CREATE INDEX [with] ON t(a)", "CREATE INDEX i ON t(a) WITH (DATA_COMPRESSION = ROW)", "create columnstore index c on t"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(texts)], "server_name string, event_id int, command_text string")
    new = [r.new_command for r in ix.index_ddl_rewrite(df).orderBy("event_id").collect()]
    assert new == [
        texts[0] + " WITH(DATA_COMPRESSION = ROW)", "create index i on t(a) WITH(DATA_COMPRESSION = ROW,PAD_INDEX = ON)",
        texts[2] + " WITH(DATA_COMPRESSION = ROW)", texts[3], texts[4],
    ]


def test_compression_arguments(spark):
    empty = spark.createDataFrame([], "a int")
    for a, b in (("ROW", "ROW"), ("ZIP", "ROW"), ("ROW", "ZIP")):
        with pytest.raises(ValueError):
            ix.compression_candidates(empty, empty, compression_from=a, compression_to=b)


def test_rowgroups_without_rows(spark):
    schema = "server_name string, database_name string, schema_name string, table_name string, index_name string, type_desc string, state_description string, total_rows bigint, deleted_rows bigint"
    base = ("s", "d", "dbo", "t")
    data = [(*base, "few", "CLUSTERED COLUMNSTORE", "COMPRESSED", 0, 3), (*base, "many", "CLUSTERED COLUMNSTORE", "COMPRESSED", 0, 5000), (*base, "open", "CLUSTERED COLUMNSTORE", "OPEN", 10, 9), (*base, "sum", "CLUSTERED COLUMNSTORE", "COMPRESSED", 100, 1), (*base, "sum", "CLUSTERED COLUMNSTORE", "COMPRESSED", 100, 3)]
    out = {r.index_name: r.rebuild for r in ix.rowgroup_maintenance(spark.createDataFrame(data, schema)).collect()}
    assert out == {"few": False, "many": True, "open": False, "sum": True}


def _edges(spark, data):
    return spark.createDataFrame(data, "package_id bigint, edge_index int, from_task bigint, to_task bigint")


def walk(edges):
    """Head edge, then the first edge that starts where the last one ends."""
    ends = {t for _, _, t in edges}
    heads = [e for e in sorted(edges) if e[1] not in ends]
    order = {}
    at = heads[0] if heads else None
    while at and at[0] not in order:
        order[at[0]] = len(order) + 1
        at = next((e for e in sorted(edges) if e[1] == at[2]), None)
    return order


def test_chain_with_gap_cycle_branch_and_length(spark, rows):
    packages = {
        1: [(0, 2, 3), (1, 1, 2), (2, 7, 8)],
        2: [(0, 1, 2), (1, 2, 3), (2, 3, 2)],
        3: [(0, 1, 2), (1, 2, 1)],
        4: [(5, 1, 2), (3, 1, 9), (4, 9, 4), (1, 2, 6)],
        5: [(i * 37 % 100, i, i + 1) for i in range(100)],
    }
    data = [(p, i, f, t) for p, es in packages.items() for i, f, t in es]
    got = rows(n.precedence_chain_order(_edges(spark, data)), "package_id", "edge_index", "position")
    expected = [(p, i, pos) for p, es in packages.items() for i, pos in walk(es).items()]
    assert got == sorted(expected, key=lambda r: tuple(map(str, r)))


def test_documents_with_empty_arrays_and_null_parts(spark, rows):
    folder = tempfile.mkdtemp(prefix="assess-")
    issue = {"Title": "t", "Category": "c", "ChangeCategory": "k", "Severity": "s", "Impact": "i", "Recommendation": "r", "MoreInfo": "m"}
    full = {**issue, "CompatibilityLevel": "150", "ImpactedObjects": [{"ObjectType": "T", "Name": "o", "ImpactDetail": "d"}] * 2}
    documents = [
        {"Databases": []}, {"Databases": [{"Name": "a", "AssessmentRecommendations": []}]},
        {"Databases": [{"Name": "a", "AssessmentRecommendations": [{**issue, "CompatibilityLevel": "160", "ImpactedObjects": []}, full]}]},
        {"Databases": [{"Name": "ReportServer", "AssessmentRecommendations": [{**full, "CompatibilityLevel": "100"}]}]},
        {"Databases": [{"Name": "b", "AssessmentRecommendations": [{**full, "Title": None}]}]},
    ]
    for i, document in enumerate(documents):
        with open(f"{folder}/{i}.json", "w") as f:
            json.dump(document, f, indent=1)
    df = n.read_assessments(spark, folder)
    assert {(r.title, r.issue_count) for r in n.dma_issue_summary(df).collect()} == {("t", 2), (None, 1)}
    assert n.dma_issue_details(df).count() == 4
    headers = {r.header for r in n.dma_summary_headers(df).collect()}
    assert None in headers and len(headers) == 2
    assert next(x for x in headers if x).endswith("Applies to: 150 (or higher)")


def test_log_listing(spark):
    folder = tempfile.mkdtemp(prefix="logs-")
    for name, old in (("job_20240101_120000.txt", True), ("job_20240102_120000.txt", False), ("job_2024_1.txt", True), ("x.log", True)):
        path = f"{folder}/{name}"
        with open(path, "w") as f:
            f.write("x")
        if old:
            os.utime(path, (1_700_000_000, 1_700_000_000))
    listing = files.list_files(spark, folder)
    assert listing.count() == 4
    gone = files.purge_log_files(listing, now=_ts("2024-06-01 00:00:00"))
    assert [r.path.rsplit("/", 1)[1] for r in gone.collect()] == ["job_20240101_120000.txt"]
    assert files.list_files(spark, folder, glob=files.LOG_GLOB, before="2024-01-01T00:00:00").count() == 1


def test_missing_index_keeps_cheap_plans_out_of_the_parser(spark, at):
    runtime = spark.createDataFrame([("s", "d", 1, 10, 5_000_000, 2_000_000, at("2024-01-02 00:00:00")), ("s", "d", 2, 1, 1, 1, at("2024-01-02 00:00:00")), ("s", "d", 3, 10, 1, 9_000_000, at("2024-01-02 00:00:00"))],
                                    "server_name string, database_name string, plan_id bigint, count_executions bigint, avg_duration_us bigint, avg_cpu_us bigint, last_execution_time timestamp_ntz")
    plans = spark.createDataFrame([("s", "d", i, i, text) for i, text in ((1, "<ShowPlanXML><BatchSequence><Batch><Statements><StmtSimple><QueryPlan><MissingIndexes><MissingIndexGroup Impact='9.5'><MissingIndex Table='[t]'/></MissingIndexGroup></MissingIndexes></QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>"), (3, "<ShowPlanXML><MissingIndexes"))],
                                  "server_name string, database_name string, plan_id bigint, query_id bigint, query_plan string")
    queries = spark.createDataFrame([("s", "d", 1, None, "q"), ("s", "d", 3, None, "q")], "server_name string, database_name string, query_id bigint, object_name string, query_sql_text string")
    out = qp.missing_index_plans(runtime, plans, queries, now=_ts("2024-01-02 12:00:00")).collect()
    assert [(r.plan_id, r.missing_table, r.impact, str(r.total_cpu_time_ms)) for r in out] == [(1, "[t]", 9.5, "20000.00")]


def test_union_sources(spark, rows):
    one = spark.createDataFrame([(1,)], "x int")
    assert rows(n.union_sources({"a": one, "b": one, "tempdb": one}, skip=("tempdb",))) == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError):
        n.union_sources({})


def test_config_fill_and_gaps(spark, rows):
    values = [(1, "A", ""), (1, "B", None), (1, "C", "x"), (1, "P", ""), (2, "P", ""), (1, c.OPTIONAL_ITEM, "")]
    config = spark.createDataFrame(values, "server_id bigint, name string, value string")
    servers = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "server_id bigint, server string")
    filled = c.config_fill(config, servers, site={"host": "h"}, defaults={"A": "1", "C": "9", "P": "{host}/{server}"})
    want = [(1, "A", "1"), (1, "B", None), (1, "C", "x"), (1, "P", "h/one"), (2, "P", ""), (1, c.OPTIONAL_ITEM, "")]
    assert rows(filled) == sorted(want, key=lambda r: tuple(map(str, r)))
    assert rows(c.config_gaps(filled), "name") == [("B",), ("P",)]
    seeded = c.config_seed(config, config, items=("Trace Flags", "Z", "Z"))
    assert rows(seeded.where("name IN ('Z', 'Trace Flags') AND server_id = 1"), "name", "description") == [
        ("Trace Flags", "csv list of the trace flags set at every start."), ("Z", "(BIT) 1 = yes, 0 = no. Z")
    ]


def test_every_item_has_a_description_and_all_but_one_a_default():
    items = c.config_items()
    assert len(items) == len(set(i[0] for i in items)) == len(c.CONFIG_ITEMS) and all(i[1] for i in items)
    assert [i[0] for i in items if i[2] is None] == [c.OPTIONAL_ITEM]


def test_notifications_are_added_or_updated(spark, rows):
    from fleetlens.operators import alerts as al

    names = ["16-Other", "17-Low", "25-High", "26", "26-No", "Error 822", "Error 823", "Error 824", "Error 825", "Error 825x"]
    alerts = spark.createDataFrame([("s", n) for n in names] * 2, "server_name string, alert_name string")
    existing = spark.createDataFrame([("s", "17-Low", "DBA", 4), ("s", "17-Low", "Other", 1), ("t", "26", "DBA", 1)], "server_name string, alert_name string, operator_name string, method int")
    got = rows(al.alert_notification_routing(alerts, existing, {"DBA": 1}), "alert_name", "method", "action")
    assert got == [("17-Low", 1, "update"), ("25-High", 1, "add"), ("26", 1, "add"), ("Error 823", 1, "add"), ("Error 824", 1, "add"), ("Error 825", 1, "add")]


def test_longest_prefix_wins(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("8.8.8.8",), (None,)], "local_net_address string")
    out = c.network_segment_map(df, {"10.": ".1", "10.1.2": "10.0.0.9"}, default=".62")
    assert [r.target_host for r in out.collect()] == ["10.0.0.9", "10.1.9.1", "8.8.8.62", ".62"]


def test_forbidden_changes_first_match(spark, at):
    text = "ALTER DATABASE x MODIFY FILE (a); SET RECOVERY SIMPLE"
    xml = f"<EVENT_INSTANCE><EventType>ALTER_DATABASE</EventType><LoginName>u</LoginName><TSQLCommand><CommandText>{text}</CommandText></TSQLCommand></EVENT_INSTANCE>"
    from fleetlens.sources import shred

    df = spark.createDataFrame([("s", 1, at("2024-01-01 00:00:00"), xml)], "server_name string, event_id bigint, post_time timestamp_ntz, message_body string")
    row = h.alter_database_policy(shred.server_event_shred(df), environment="test").first()
    assert row.violation == f"Altering the RECOVERY model is not permitted in test environments.\r\n\r\n{text}"


@pytest.mark.parametrize(("inner", "cells"), [
    ("<A><A>x</A><B>y</B></A><C/>", [("A", "xy"), ("C", "")]),
    ("<A><![CDATA[1 < 2 & 3]]></A><!-- <D>no</D> --><p:B k='>'>b</p:B>", [("A", "1 &lt; 2 &amp; 3"), ("B", "b")]),
    ("\n <A>one\r\ntwo</A> <B><E/><E>z</E>&quot;</B>\n", [("A", "one<br/>two"), ("B", 'z"')]),
    ("<A><![CDATA[<!-- kept -->]]></A><A><![CDATA[]]></A>", [("A", "&lt;!-- kept --&gt;"), ("A", "")]),
    ("", []),
])
def test_event_to_html(spark, inner, cells):
    from pyspark.sql import functions as F

    from fleetlens.operators.events import event_to_html

    df = spark.createDataFrame([(f"<EVENT_INSTANCE>{inner}</EVENT_INSTANCE>",)], "body string")
    want = "".join(f"<tr><td>{n}</td><td>{v}</td></tr>" for n, v in cells)
    assert df.select(event_to_html(F.col("body"))).first()[0] == f'<table border="1">{want}</table><br/>'


def test_event_to_html_of_a_document_with_many_children(spark):
    import time

    from pyspark.sql import functions as F

    from fleetlens.operators.events import event_to_html

    inner = "".join(f"<A{i}><B>x</B>\n<C/>y &quot;{i}</A{i}><D k=\"1>2\">{i} > 0</D> " for i in range(3000))
    want = "".join(f'<tr><td>A{i}</td><td>x\ny "{i}</td></tr><tr><td>D</td><td>{i} > 0</td></tr>' for i in range(3000))
    df = spark.createDataFrame([(f"<EVENT_INSTANCE>{inner}</EVENT_INSTANCE>",)], "body string")
    start = time.monotonic()
    assert df.select(event_to_html(F.col("body"))).first()[0] == f'<table border="1">{want}</table><br/>'
    # lists of the document that are built again for every tag took over a minute
    assert time.monotonic() - start < 20
