import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlens.functions.ordered import asof_latest, latest_so_far, number_rows

BASE = dt.datetime(2024, 1, 1)


def _history(n, seed, keys=("a", "b", "c")):
    """One key holds most rows, times repeat, values have gaps."""
    r = random.Random(seed)
    return [
        (r.choice([keys[0]] * 6 + list(keys)), BASE + dt.timedelta(hours=r.randrange(4000)), i, r.choice([None, 1, 2, 3]))
        for i in range(n)
    ]


def test_latest_so_far_equals_a_scan(spark, rows):
    data = _history(400, 1)
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, id int, v int")
    for strict in (False, True):
        got = rows(latest_so_far(df, ["k"], "t", "v", "last", ties=["id"], strict=strict, block="DAY"), "id", "last")
        expected, state = [], {}
        for k, _, i, v in sorted(data, key=lambda x: (x[0], x[1], x[2])):
            before = state.get(k)
            state[k] = v if v is not None else before
            expected.append((i, before if strict else state[k]))
        assert got == sorted(expected, key=lambda r: tuple(str(x) for x in r))


def test_asof_latest_equals_a_scan(spark, rows):
    history = [(k, t, i) for k, t, i, _ in _history(300, 2)]
    asked = [(k, t + dt.timedelta(minutes=i % 3), i) for k, t, i, _ in _history(60, 3, keys=("a", "b", "x"))]
    got = asof_latest(
        spark.createDataFrame(history, "k string, t timestamp_ntz, id bigint"),
        spark.createDataFrame(asked, "k string, q timestamp_ntz, rid int"), ["k"], "t", "q", ["id"], ties=["id"],
    )
    expected = []
    for k, q, rid in asked:
        past = [(t, i) for hk, t, i in history if hk == k and t <= q]
        expected.append((rid, max(past)[1] if past else None))
    assert rows(got.select("rid", F.col("asof.id").alias("id"))) == sorted(expected, key=lambda r: tuple(str(x) for x in r))


def test_number_rows_is_dense_and_ordered(spark):
    names = [f"n{i * 7 % 500:03d}" for i in range(500)]
    numbered = number_rows(spark.createDataFrame([(n,) for n in names], "name string"), ["name"], "n").collect()
    assert [r.n for r in sorted(numbered, key=lambda r: r.name)] == list(range(1, 501))


def test_asof_ties_keep_their_type(spark, at):
    t = at("2024-01-01 00:00:00")
    long = "x" * 30
    history = spark.createDataFrame(
        [("a", t, -5, long + "a", 1), ("a", t, -40, long + "z", 2), ("b", t, 9, long + "b", 3), ("b", t, 9, long + "a", 4), ("b", t, 10, "", 5)],
        "k string, t timestamp_ntz, n int, s string, v int",
    )
    asked = spark.createDataFrame([("a", t), ("b", t)], "k string, at timestamp_ntz")
    got = asof_latest(history, asked, ["k"], "t", "at", ["v"], ties=["n", "s"])
    assert {r.k: r.asof.v for r in got.collect()} == {"a": 1, "b": 5}
    got = asof_latest(history, asked, ["k"], "t", "at", ["v"], ties=["s"])
    assert {r.k: r.asof.v for r in got.collect()} == {"a": 2, "b": 3}
