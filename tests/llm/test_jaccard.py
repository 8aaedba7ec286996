import itertools
import random
import re

import pytest

from fleetlens.llm import jaccard


def token_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_force(rows, k, percent):
    sets = [token_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), lowest[find(i)]) for i, (doc_id, _) in enumerate(rows))


def planted(seed, n=260):
    """Texts with shared passages, chains of near copies, exact copies and tiny texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda m: [rng.choice(words) for _ in range(m)]
    passages, out, base = [text(60) for _ in range(3)], [], None
    for i in range(n):
        kind = i % 6
        if kind == 0 or base is None:
            base = text(rng.choice([5, 9, 14, 40, 120, 300]))
        if kind == 1:
            doc = text(20) + passages[rng.randrange(3)] + text(rng.randrange(30))
        elif kind == 2:
            doc = passages[rng.randrange(3)] + passages[rng.randrange(3)] + text(rng.randrange(4))
        else:
            doc = list(base)
            for _ in range(rng.randrange(3)):
                doc[rng.randrange(len(doc))] = rng.choice(words)
        if rng.random() < 0.5:
            base = doc
        out.append((i, (" " if rng.random() < 0.5 else "\n").join(doc).upper() if i % 9 == 0 else " ".join(doc)))
    return out + [(n, ""), (n + 1, None), (n + 2, "One"), (n + 3, "one"), (n + 4, "one two three"), (n + 5, " \t\n")]


@pytest.mark.parametrize("seed,frequent,percent", [(1, 2, 85), (2, 4, 85), (3, 24, 80), (4, 1, 70)])
def test_components_equal_brute_force(spark, rows, monkeypatch, seed, frequent, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    data = planted(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rows(jaccard.near_equal(df, k=4, percent=percent), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == brute_force(data, 4, percent)


def test_whole_sets_are_used_where_the_counted_tokens_are_frequent(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(7)
    base = [f"v{i}" for i in range(500)]
    data = []
    for i in range(30):
        doc = list(base)
        for _ in range(rng.randrange(1, 9)):
            doc[rng.randrange(500)] = f"x{rng.random()}"
        data.append((i, " ".join(doc)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(jaccard.near_equal(df), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == brute_force(data, 4, 85)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node string, tokens string")
    assert jaccard.near_equal(empty).count() == 0
    data = [(1, "a b c d e f", "x", 3), (2, "a b c d e f", None, 4), (None, "a b c d e f", None, 4), (3, None, "n", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, node string, n int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_equal(df).collect()}
    assert got == {(1, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3)}
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def edited(rng, base, m, fresh):
    """A copy with m words at random places replaced; from a small set of words unless ``fresh``."""
    doc = list(base)
    for at in rng.sample(range(len(doc)), m):
        doc[at] = f"x{rng.random()}" if fresh else f"y{rng.randrange(3)}"
    return doc


@pytest.mark.parametrize("seed,fresh", [(11, True), (12, False)])
def test_clusters_just_beyond_the_limit(spark, rows, monkeypatch, seed, fresh):
    """Copies that miss the hub by a little, some of them linked by copies of themselves."""
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = random.Random(seed)
    base, line = [f"v{i}" for i in range(120)], [f"common{i}" for i in range(30)]
    data = [base]
    for _ in range(60):
        doc = edited(rng, base, rng.randrange(1, 6), fresh)
        data.append(doc)
        if rng.random() < 0.4:
            data.append(edited(rng, doc, 1, fresh))
        if rng.random() < 0.2:
            data.append(doc[: rng.randrange(90, 120)])
        if rng.random() < 0.3:
            data.append(line + [f"z{rng.random()}" for _ in range(rng.randrange(3, 20))])
    data = [(i, " ".join(d)) for i, d in enumerate(data)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(jaccard.near_equal(df), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == brute_force(data, 4, 85)


def test_null_and_repeated_ids_and_long_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, rng.randrange(4), True)) for _ in range(30)]
    long = [f"w{rng.randrange(9000)}" for _ in range(20000)]
    data = [(None, t) for t in texts] + [(7, t) for t in texts[:10]] + [(7, texts[0])] * 3
    data += [(100, " ".join(long)), (101, " ".join(edited(rng, long, 200, True)))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    join = jaccard._Join(df, 4, 85)
    whole = join.whole_sets(join.nodes)
    assert whole.count() == join.nodes.count() == join.heads.count() == len({frozenset(token_set(t, 4)) for _, t in data})
    number = [(i, t) for i, (_, t) in enumerate(data)]
    groups = {}
    for i, _, c in brute_force(number, 4, 85):
        groups.setdefault(c, []).append(i)
    lowest = {i: min((data[j][0] for j in g if data[j][0] is not None), default=None) for g in groups.values() for i in g}
    want = sorted(((data[i][0], len(token_set(t, 4)), lowest[i]) for i, t in number), key=str)
    got = rows(jaccard.near_equal(df), "doc_id", "n_shingles", "component_id")
    assert sorted(got, key=str) == want


def test_counted_tokens_are_moved_once(spark, monkeypatch):
    """Where no side is small enough to broadcast, the rows of all counted tokens pass one exchange."""
    df = spark.createDataFrame(planted(9, 60)[:60], "doc_id long, text string")
    join, plans = jaccard._Join(df, 4, 85), []

    def cut(found, real=jaccard.cut):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return real(found)

    monkeypatch.setattr(jaccard, "cut", cut)
    monkeypatch.setattr(jaccard, "small_side", lambda side, **_: side)
    monkeypatch.setattr(jaccard, "_small", jaccard.F.broadcast)
    join.index()
    moved = 0
    for plan in plans:
        for part in re.split(r"(?=Exchange )", plan.split("== Initial Plan ==")[-1]):
            by_token = part.startswith("Exchange hashpartitioning(token#") and "posexplode" in part
            # of the sample and of the few crowded tokens only sums move
            sums = "xxhash64" in part or re.search(r"\[token#\d+L\], \[token#\d+L\], LeftSemi", part)
            moved += by_token and not sums
    assert moved == 1


@pytest.mark.parametrize("seed,sample,crowded,side", [(1, 4096, 40, 0), (2, 16, 2, 0), (5, 64, 3, 8 << 20)])
def test_crowded_tokens_and_sides_that_are_not_broadcast(spark, rows, monkeypatch, seed, sample, crowded, side):
    for name, value in (("FREQUENT", 4), ("SAMPLE", sample), ("CROWDED", crowded), ("SIDE_BYTES", side)):
        monkeypatch.setattr(jaccard, name, value)
    data = planted(seed)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rows(jaccard.near_equal(df), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == brute_force(data, 4, 85)
