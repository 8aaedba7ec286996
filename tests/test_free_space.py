from fleetlens.operators import alerts as a

SCHEMA = "server_name string, drive string, sample_time timestamp_ntz, mb_free int"


def fold(samples, threshold, minutes, resets=()):
    """Row by row: the state of each drive is its last amount and last alert."""
    state, out = {}, []
    events = [(t, 0, s, d, None) for s, d, t in resets] + [(t, 1, s, d, m) for s, d, t, m in samples]
    for t, kind, s, d, free in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3])):
        if kind == 0:
            state[s, d] = (-1, None)
        elif free < threshold:
            amount, alerted = state.get((s, d), (-1, None))
            updated = free != amount or alerted is None or (t - alerted).total_seconds() > minutes * 60
            if updated:
                state[s, d] = (free, t)
            out.append((s, d, t, free, updated))
    return sorted(out, key=lambda r: tuple(str(x) for x in r))


def _samples(at):
    t = [at(f"2024-01-01 00:{m:02d}:00") for m in range(0, 60, 5)]
    return (
        [("s", "C", x, 500) for x in t]
        + [("s", "D", x, 900 - 10 * (i // 6)) for i, x in enumerate(t)]
        + [("s", "E", x, 5000 if i % 3 else 100) for i, x in enumerate(t)]
        + [("r", "C", at("2024-01-02 23:59:59"), 1), ("r", "C", at("2024-01-03 00:14:59"), 1), ("r", "C", at("2024-01-03 00:15:00"), 1)]
    )


def test_updates_equal_a_fold(spark, rows, at):
    samples = _samples(at)
    df = spark.createDataFrame(samples, SCHEMA)
    assert rows(a.free_space_updates(df)) == fold(samples, 1024, 15)


def test_reset_makes_the_next_check_alert(spark, rows, at):
    samples = _samples(at)
    resets = [("s", "C", at("2024-01-01 00:05:00")), ("s", "D", at("2024-01-01 00:51:00")), ("s", "E", at("2024-01-01 00:44:00"))]
    df = spark.createDataFrame(samples, SCHEMA)
    seeds = spark.createDataFrame(resets, "server_name string, drive string, sample_time timestamp_ntz")
    assert rows(a.free_space_updates(df, resets=seeds)) == fold(samples, 1024, 15, resets)


def test_severity_is_per_check(spark, at):
    samples = [
        ("s", "C", at("2024-01-01 00:00:00"), 5), ("s", "D", at("2024-01-01 00:00:00"), 6),
        ("s", "C", at("2024-01-01 00:01:00"), 5), ("s", "D", at("2024-01-01 00:01:00"), 7),
        ("s", "C", at("2024-01-01 00:02:00"), 5), ("s", "D", at("2024-01-01 00:02:00"), 7),
    ]
    out = a.free_space_alerts(spark.createDataFrame(samples, SCHEMA)).orderBy("sample_time").collect()
    assert [r.severity for r in out] == [17, 17, 16]
    assert out[0].message.endswith("C:\t5 MB\r\nD:\t6 MB\r\n")
