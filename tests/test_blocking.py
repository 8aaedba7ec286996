import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import blocking as k

SCHEMA = "server_name string, blocked_process_id bigint, post_time timestamp_ntz, monitor_loop bigint, blk_spid bigint, vic_spid bigint, duration_ms bigint"


def _edges(spark, at, pairs):
    t = at("2024-01-01 00:00:00")
    return spark.createDataFrame([("s", i, t, loop, b, v, d) for i, (loop, b, v, d) in enumerate(pairs)], SCHEMA)


def test_diamond_counts_both_paths(spark, rows, at):
    edges = _edges(spark, at, [(1, 1, 2, 10), (1, 2, 3, 20), (1, 2, 4, 30), (1, 3, 5, 40), (1, 4, 5, 50), (1, 5, 6, 61)])
    out = k.blocking_chain_metrics(k.lead_blockers(edges))
    # seven rows on the paths: the last victim is reached twice, so 61 counts twice
    assert rows(out, "blocked_process_id", "spids_blocked", "total_duration_ms", "avg_duration_ms") == [(0, 7, 272, 38)]


def test_leads_without_chains(spark, rows, at):
    out = k.blocking_chain_metrics(k.lead_blockers(_edges(spark, at, [(1, 1, 2, 10), (2, 2, 3, 7)])))
    assert rows(out, "blocked_process_id", "spids_blocked", "total_duration_ms") == [(0, 1, 10), (1, 1, 7)]


def test_a_cycle_gives_a_status_and_spoils_no_other_lead(spark, rows, at):
    pairs = [(1, 1, 2, 1), (1, 2, 3, 1), (1, 3, 2, 1), (1, 9, 2, 4), (1, 7, 8, 5), (1, 8, 6, 6), (2, 1, 2, 3), (2, 2, 3, 4)]
    out = k.blocking_chain_metrics(k.lead_blockers(_edges(spark, at, pairs)))
    assert rows(out, "blocked_process_id", "chain_status", "spids_blocked", "total_duration_ms") == [
        (0, "cycle", None, None), (3, "cycle", None, None), (4, "complete", 2, 11), (6, "complete", 2, 7),
    ]


def components(pairs):
    """Mutual reachability by plain search."""
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)

    def reach(a):
        seen, open_ = set(), [a]
        while open_:
            for b in below.get(open_.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    open_.append(b)
        return seen

    to = {a: reach(a) for a in below}
    return {a: {b for b in to[a] if a in to.get(b, ())} for a in to if a in to[a]}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_are_the_strongly_connected_components(spark, at, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)}
    if seed == 2:  # circles of many sizes, also of odd ones, with bridges between them
        pairs = {(10 * i + j, 10 * i + (j + 1) % (i + 2)) for i in range(6) for j in range(i + 2)} | {(0, 10), (11, 30), (30, 22), (99, 0)}
    pairs = {(a, b) for a, b in pairs if a != b}
    edges = _edges(spark, at, [(loop, a, b, 1) for loop in (1, 2) for a, b in sorted(pairs)] + [(3, 1, 2, 1), (1, None, 2, 1), (1, 2, None, 1)])
    got = {(r.monitor_loop, r.spid): (r.cycle_id, r.sessions) for r in k.blocking_cycles(edges).collect()}
    want = {(loop, a): (min(c), len(c)) for loop in (1, 2) for a, c in components(pairs).items()}
    assert got == want and want


def test_no_cycles(spark, at):
    assert k.blocking_cycles(_edges(spark, at, [(1, 1, 2, 1)])).count() == 0
    assert k.blocking_cycles(_edges(spark, at, [])).count() == 0


def test_counts_beyond_a_long_are_null(spark, at):
    """Seventy diamonds in a row: 2**70 paths."""
    pairs = [p for i in range(70) for p in ((1, 3 * i, 3 * i + 1, 1), (1, 3 * i, 3 * i + 2, 1), (1, 3 * i + 1, 3 * i + 3, 1), (1, 3 * i + 2, 3 * i + 3, 1))]
    got = k.blocking_chain_metrics(k.lead_blockers(_edges(spark, at, pairs + [(2, 1, 2, 5)]))).collect()
    assert [(r.chain_status, r.spids_blocked) for r in got if r.monitor_loop == 1] == [("complete", None)] * 2
    assert [r.total_duration_ms for r in got if r.monitor_loop == 2] == [5]


def test_long_chain_needs_few_rounds(spark, rows, at):
    pairs = [(1, i, i + 1, 1) for i in range(1, 1001)] + [(1, i, 5000 + i, 2) for i in range(2, 1001, 7)]
    out = k.blocking_chain_metrics(k.lead_blockers(_edges(spark, at, pairs)))
    assert rows(out, "blocked_process_id", "spids_blocked", "total_duration_ms") == [(0, 1143, 1286)]


def test_leads_come_by_total_duration(spark, at):
    edges = _edges(spark, at, [(1, 1, 2, 10), (1, 3, 4, 70), (1, 4, 5, 5)])
    out = k.blocking_chain_metrics(k.lead_blockers(edges)).collect()
    assert [(r.blocked_process_id, r.total_duration_ms) for r in out] == [(1, 75), (0, 10)]


def test_a_cycle_without_a_lead(spark, rows, at):
    edges = _edges(spark, at, [(1, 1, 2, 1), (2, 7, 8, 1), (2, 8, 9, 1), (2, 9, 7, 1)])
    out = k.blocking_chain_metrics(k.lead_blockers(edges))
    assert rows(out, "blocked_process_id", "chain_status", "total_duration_ms") == [(0, "complete", 1)]
    assert rows(k.blocking_cycles(edges), "spid", "cycle_id", "sessions") == [(7, 7, 3), (8, 7, 3), (9, 7, 3)]


def test_unknown_victim_hides_every_lead_of_its_loop(spark, rows, at):
    edges = _edges(spark, at, [(1, 1, 2, 1), (1, 3, None, 1), (2, 5, 6, 1)])
    flagged = k.lead_blockers(edges)
    assert rows(flagged.where("is_lead_blocker"), "blocked_process_id") == [(2,)]


def test_dedupe_keeps_the_lowest_id_and_drops_self_blocking(spark, rows, at):
    edges = _edges(spark, at, [(1, 1, 1, 9), (1, 1, 2, 5), (1, 1, 2, 6), (1, None, 2, 1)])
    kept = k.blocked_process_dedupe(edges, now=F.lit(at("2024-01-02 00:00:00")).cast("timestamp_ntz"))
    assert rows(kept, "blocked_process_id", "duration_ms") == [(1, 5)]
    none = k.blocked_process_dedupe(edges, now=F.lit(at("2024-01-04 00:00:00")).cast("timestamp_ntz"))
    assert none.isEmpty()
