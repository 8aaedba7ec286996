import random
import re

from fleetlens.llm import decontaminate as d


def shingles(words):
    n = min(5, len(words))
    out = {}
    for i in range(len(words) - n + 1):
        key = tuple(words[i : i + n])
        out[key] = out.get(key, 0) + 1
    return out


def brute_force(docs, items):
    """Best weighted similarity of every document and item over all item-sized windows."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for doc_id, text in docs:
        words = split(text)
        for item_id, item in items:
            want = split(item)
            best = 0
            for i in range(len(words) - len(want) + 1) if want else ():
                a, b = shingles(want), shingles(words[i : i + len(want)])
                keys = set(a) | set(b)
                low = sum(min(a.get(x, 0), b.get(x, 0)) for x in keys)
                best = max(best, low / sum(max(a.get(x, 0), b.get(x, 0)) for x in keys))
            if best >= 0.8:
                out[doc_id, item_id] = round(best, 9)
    return out


def planted():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda m: [rng.choice(words) for _ in range(m)]
    items = [(i, text(rng.choice([3, 6, 14, 25, 40, 60]))) for i in range(25)]
    items += [(90, items[4][1]), (91, items[5][1][:-1] + ["other"]), (92, ["one"])]
    docs = []
    for i in range(60):
        body = text(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            copy = list(rng.choice(items)[1])
            if rng.random() < 0.5:
                copy[rng.choice([0, -1, len(copy) // 2])] = "changed"
            body += copy + text(rng.randrange(10))
        docs.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [(70, ""), (71, None), (72, " . "), (73, "One"), (74, " ".join(items[9][1] * 3))]
    return docs, [(i, " ".join(w)) for i, w in items] + [(95, ""), (96, None)]


def test_matches_equal_brute_force(spark):
    docs, items = planted()
    got = d.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute_force(docs, items)


def test_parts_of_the_benchmark_give_the_same(spark):
    docs, items = planted()
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in d.leaks(*args).collect()}
    assert {(r.doc_id, r.item_id) for r in d.leaks(*args, part_items=7).collect()} == whole


def test_empty_tables_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 1), (2, None, 2), (3, "x", 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(None, "a b c d e f g")], "item_id long, text string")
    assert [tuple(r) for r in d.leaks(docs, items).collect()] == [(None, None, 1.0, 0, 7)]
    kept = d.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert d.leaks(docs.limit(0), items).count() == 0
    assert d.leaks(docs, items.limit(0)).count() == 0


def test_documents_shorter_than_an_item_are_one_window(spark):
    """A shortened item as a whole document: similarity of all its shingles to those of the item."""
    rng = random.Random(5)
    items = [(n, [f"v{rng.randrange(400)}" for _ in range(n)]) for n in (3, 4, 5, 9, 12, 24, 25, 50, 59)]
    docs = [(100 * n + k, w[k // 2 : n - (k - k // 2)]) for n, w in items for k in range(min(n, 14))]
    want = {}
    for doc_id, words in docs:
        for item_id, item in items:
            size = min(5, len(item))
            if 0 < len(words) < len(item):
                a, b = shingles(item), shingles(words) if len(words) >= size else {}
                low = sum(min(a[x], b.get(x, 0)) for x in a)
                s = low / (sum(a.values()) + sum(b.values()) - low)
            else:
                s = 1.0 if words == item else 0
            if s >= 0.8:
                want[doc_id, item_id] = round(s, 9), 0, len(words)
    assert want[5001, 50] == (round(45 / 46, 9), 0, 49) and len(want) > 20
    d_, i_ = (spark.createDataFrame([(k, " ".join(w)) for k, w in x], f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_words) for r in d.leaks(d_, i_).collect()}
    assert got == want
    assert {r.doc_id for r in d.decontaminated(d_, i_).collect()} == {k for k, _ in docs} - {k for k, _ in want}
