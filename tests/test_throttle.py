import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from fleetlens.operators import alerts as a
from fleetlens.operators import throttle as th


def greedy(instants, delay):
    out, last = [], None
    for t in sorted(set(instants)):
        if last is None or t >= last + delay:
            out.append(t)
            last = t
    return out


def _keys(case):
    rng = np.random.default_rng(case)
    return {
        "hot": rng.integers(0, 3_000_000, 4000).tolist(),
        "periodic": list(range(0, 2_000_000, 700)),
        "sparse": rng.integers(0, 90_000_000, 40).tolist(),
        "single": [5],
        "before epoch": rng.integers(-3_000_000, 1_000_000, 300).tolist(),
    }


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("block", [1, 2, 16])
def test_throttle_equals_a_fold(spark, rows, monkeypatch, case, block):
    monkeypatch.setattr(th, "BLOCK_DELAYS", block)
    delay = 9_100
    keys = _keys(case)
    data = [(k, t, delay) for k, ts in keys.items() for t in ts]
    df = spark.createDataFrame(data, "k string, t bigint, d bigint")
    # the setting must reach the workers, so the functions are used directly as well
    expected = sorted(((k, t) for k, ts in keys.items() for t in greedy(ts, delay)), key=lambda r: tuple(map(str, r)))
    by_hand = []
    for k, ts in keys.items():
        instants = np.array(sorted(set(ts)))
        blocks = np.floor_divide(instants, delay * block)
        steps = [th._steps({"_us": instants[blocks == b], "_delay": np.array([delay]), "_block": np.array([b])}) for b in np.unique(blocks)]
        merged = {n: np.concatenate([s[i] for s in steps]) for i, n in enumerate(("_block", "_delay", "entry", "exit"))}
        for b, opened in zip(*th._chain(merged)):
            part = {"_us": instants[blocks == b], "_delay": np.array([delay]), "_open": np.array([opened])}
            by_hand += [(k, int(t)) for t in th._emit(part)[0]]
    assert sorted(by_hand, key=lambda r: tuple(map(str, r))) == expected
    monkeypatch.undo()
    assert rows(th.throttle(df, ["k"], "t", "d")) == expected


def test_exactly_the_delay_apart_responds(spark, rows, at):
    data = [
        ("s", "x", 1, at("2024-01-01 00:00:00"), 600), ("s", "x", 2, at("2024-01-01 00:09:59"), 600),
        ("s", "x", 3, at("2024-01-01 00:10:00"), 600), ("s", "x", 4, at("2024-01-01 00:19:59.999999"), 600),
        ("s", "y", 5, at("2024-01-01 00:00:00"), 0), ("s", "y", 6, at("2024-01-01 00:00:00"), 0),
        ("s", "x", 7, at("2024-01-01 00:10:00"), 600),
    ]
    df = spark.createDataFrame(data, "server_name string, alert_name string, event_id bigint, ts timestamp_ntz, delay_seconds int")
    assert rows(a.alert_throttle(df), "event_id") == [(1,), (3,), (5,), (6,)]


def test_reset_names(spark):
    names = ["17-x", "25-Fatal Error", "26", "26-x", "Error 823", "Error 8231", "Failed"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n for r in df.where(a.resettable(df.n)).collect()}
    assert got == {"17-x", "25-Fatal Error", "26", "Error 823"}


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    payload = cloudpickle.dumps(th._per_key(th._steps, ["k"], ["_block", "_delay", "entry", "exit"]))
    code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'fleetlens' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=payload, cwd=tmp_path, check=True)
