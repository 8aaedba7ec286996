"""Dependencies through other objects."""

import random

from fleetlens.operators import nested as n

SCHEMA = (
    "server_name string, database_name string, schema_name string, object_name string, referenced_server_name string, "
    "referenced_database_name string, referenced_schema_name string, referenced_entity_name string"
)


def closure(spark, rows):
    got = n.dependency_closure(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.object_name, r.needed_object_name): (r.depth, r.in_cycle) for r in got}


def test_equals_a_search_from_every_object(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    want = {}
    for a in below:
        seen, level, depth = {}, below[a], 0
        while level:
            depth += 1
            seen |= {b: depth for b in level}
            level = {c for b in level for c in below.get(b, ())} - set(seen)
        want |= {(f"o{a}", f"o{b}"): (k, a in seen) for b, k in seen.items()}
    rows = [("s", "d", "dbo", f"o{a}", None, None, None, f"o{b}") for a, b in pairs]
    assert closure(spark, rows + rows[:9]) == want


def test_circles_of_several_lengths_and_ways_of_other_lengths(spark):
    """Pairs found again between the depths at which all pairs are left out; ends, and keeps the fewest steps."""
    pairs = {(a, (a + 1) % 7) for a in range(7)} | {(10 + a, 10 + (a + 1) % 3) for a in range(3)}
    pairs |= {(6, 10), (11, 20), (20, 20), (20, 21), (21, 22), (22, 20), (0, 22), (30, 31), (31, 30), (30, 0), (2, 21)}
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    want = {}
    for a in below:
        seen, level, depth = {}, below[a], 0
        while level:
            depth += 1
            seen |= {b: depth for b in level}
            level = {c for b in level for c in below.get(b, ())} - set(seen)
        want |= {(f"o{a}", f"o{b}"): (k, a in seen) for b, k in seen.items()}
    assert closure(spark, [("s", "d", "dbo", f"o{a}", None, None, None, f"o{b}") for a, b in pairs]) == want


def test_rounds_keep_numbers_and_not_names(spark):
    from pathlib import Path

    from fleetlens.session import shared_dir

    rng = random.Random(5)
    names = [[rng.randbytes(200).hex() for _ in range(10)] for _ in range(9)]
    rows = [("s", "d", "dbo", a, None, None, None, b) for i in range(8) for a in names[i] for b in names[i + 1]]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    old = set(folder.rglob("part-*"))
    got = n.dependency_closure(spark.createDataFrame(rows, SCHEMA))
    written = sum(f.stat().st_size for f in set(folder.rglob("part-*")) - old)
    # 3,600 pairs of two names of 400 bytes; 800 references and 90 objects are kept with their names
    assert got.count() == 3600 and 0 < written < 1_500_000


def test_a_long_chain(spark):
    rows = [("s", "d", "dbo", f"o{i}", None, None, None, f"o{i + 1}") for i in range(20)]
    got = closure(spark, rows)
    assert len(got) == 210 and got["o0", "o20"] == (20, False)


def test_names_and_places(spark):
    rows = [
        ("S", "d", "dbo", "A", None, "E", "X", "b"), ("s", "e", "x", "B", "t", "f", None, "c"), ("T", "F", "DBO", "C", None, None, None, "d"),
        ("s", "d", "x", "b", None, None, None, "never"), ("s", "d", "dbo", "a", None, None, None, None),
    ]
    got = n.dependency_closure(spark.createDataFrame(rows, SCHEMA)).where("object_name = 'a'").collect()
    assert sorted((r.needed_server_name, r.needed_database_name, r.needed_schema_name, r.needed_object_name, r.depth) for r in got) == [
        ("s", "e", "x", "b", 1), ("t", "f", "dbo", "c", 2), ("t", "f", "dbo", "d", 3)
    ]
    assert closure(spark, []) == {}
