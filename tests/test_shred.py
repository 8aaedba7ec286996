from fleetlens.sources import shred
from fleetlens.streaming import handlers as h


def test_blocked_report_bad_and_partial_documents(spark, rows, at):
    t = at("2024-01-01 00:00:31")
    good = (
        '<TextData><blocked-process-report monitorLoop="7"><blocked-process><process spid="5" waittime="abc"><inputbuf> a &lt; b </inputbuf></process></blocked-process>'
        '<blocking-process><process spid="9"/></blocking-process></blocked-process-report></TextData>'
    )
    data = [("s", i, t, 2999, 1, 1, False, "u", text) for i, text in enumerate([good, "<TextData><broken", "<TextData/>", None])]
    df = spark.createDataFrame(data, "server_name string, blocked_process_id bigint, post_time timestamp_ntz, duration_us bigint, database_id int, index_id int, is_system boolean, session_login_name string, text_data string")
    out = rows(shred.blocked_process_shred(df), "blocked_process_id", "duration_ms", "monitor_loop", "blk_spid", "vic_spid", "vic_waittime", "vic_inputbuf", "post_time")
    minute = at("2024-01-01 00:01:00")
    assert out[0] == (0, 2, 7, 9, 5, None, " a < b ", minute)
    assert [r[2:7] for r in out[1:]] == [(None,) * 5] * 3
    assert len(shred.blocked_process_shred(df).columns) == 8 + 21 + 31 + 2


def test_blocked_reports_are_not_dealt_by_database(spark, at):
    """The join with the databases is a broadcast, whatever size the planner takes their source for."""
    report = "server_name string, database_id int, blocked_process_id bigint, post_time timestamp_ntz, duration_us bigint, index_id int, is_system boolean, session_login_name string, text_data string"
    df = spark.createDataFrame([("s", i % 2, i, at("2024-01-01 00:00:00"), 1, 1, False, "u", "<TextData/>") for i in range(4)], report)
    names = spark.range(3).selectExpr("'s' AS server_name", "cast(id AS int) AS database_id", "concat('d', id) AS database_name").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = shred.blocked_process_shred(df, names)
        assert sorted(r.database_name for r in out.collect()) == ["d0", "d0", "d1", "d1"]
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_error_event_nodes(spark):
    text = (
        '<event name="error_reported" timestamp="2024-01-01T10:00:00.123Z"><data name="severity"><value>16</value></data><data name="state"><value>x</value></data>'
        '<data name="is_intercepted"><value>false</value></data><data name="destination"><value>1</value><text>USER</text></data></event>'
    )
    df = spark.createDataFrame([("o", text), ("o", "<event"), ("o", None)], "object_name string, event_data string")
    first, bad, none = shred.error_event_shred(df).collect()
    assert (first.severity, first.state, first.is_intercepted, first.destination, first.message) == (16, None, False, "USER", None)
    assert str(first.timestamp) == "2024-01-01 10:00:00.123000"
    assert bad.severity is None and none.severity is None


def test_ring_buffer_without_events(spark):
    df = spark.createDataFrame([("s", '<RingBufferTarget totalEventsProcessed="0"/>'), ("s", "<broken")], "server_name string, target_data string")
    assert shred.ring_buffer_explode(df).isEmpty()


def test_ring_buffer_session_numbers_beyond_two_bytes(spark):
    numbers = ["7", "32767", "32768", "2147483647", "2147483648", "x"]
    events = "".join(f'<event name="e"><action name="session_id"><value>{n}</value></action></event>' for n in numbers)
    df = spark.createDataFrame([("s", f"<RingBufferTarget>{events}</RingBufferTarget>")], "server_name string, target_data string")
    assert [r.session_id for r in shred.ring_buffer_explode(df).collect()] == [7, 32767, 32768, 2147483647, None, None]


def test_deadlock_with_one_process_and_without_any(spark, at):
    def doc(processes):
        return f'<event name="xml_deadlock_report" timestamp="2024-07-01T12:00:00Z"><data name="xml_report"><value><deadlock><process-list>{processes}</process-list></deadlock></value></data></event>'

    data = [
        ("s", 1, at("2024-01-01 00:00:00"), "o", doc('<process spid="4"><inputbuf>x &amp; y</inputbuf></process>')),
        ("s", 2, at("2024-01-01 00:00:00"), "o", doc("")), ("s", 3, at("2024-01-01 00:00:00"), "o", "<event"),
    ]
    df = spark.createDataFrame(data, "server_name string, event_id bigint, ts timestamp_ntz, object_name string, event_data string")
    one, empty, bad = shred.deadlock_shred(df, zone="America/New_York").orderBy("event_id").collect()
    assert (one.spid_vic, one.inputbuf_vic, one.spid_win) == (4, "x & y", None)
    assert str(one.timestamp) == "2024-07-01 08:00:00"  # daylight saving is followed
    assert empty.spid_vic is None and empty.xml_deadlock_report.startswith("<deadlock>")
    assert bad.xml_deadlock_report is None


def test_server_event_html_escapes_and_breaks_lines(spark, at):
    text = "<EVENT_INSTANCE><EventType>CREATE_TABLE</EventType><TextData>a &lt; b\r\nc</TextData></EVENT_INSTANCE>"
    df = spark.createDataFrame([("s", 1, at("2024-01-01 00:00:00"), text)], "server_name string, event_id bigint, post_time timestamp_ntz, message_body string")
    row = h.good_events(shred.server_event_shred(df)).select(h.event_to_html(shred.F.col("message_body")).alias("html")).first()
    assert "<td>TextData</td><td>a &lt; b" in row.html and "\r\n" not in row.html
