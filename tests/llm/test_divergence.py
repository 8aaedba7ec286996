import collections
import random
import re

import numpy as np

from fleetlens.llm import divergence as d

SCHEMA = "text string, lang string, source string, n int, term string, value int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(rows, min_docs, top):
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        table = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(table[s][t] for s in sources) for t in kept}
        p = {s: {t: share(n, sum(of.values())) for t, n in of.items()} for s, of in table.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)}
            ahead = {t: p[s][t] - share(whole[t], sum(whole.values())) for t in kept if table[s][t]}
            first = sorted((-v, t.encode(), t) for t, v in ahead.items() if v > 0)[:top]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(first, 1)}
    return out


def documents(seed, n):
    rng = random.Random(seed)
    words = ["a", "Ab", "abc", "é", "straße", "STRASSE", "abcdef", "abcdefg", "abcdefgh", "Éa", "日本語", "x" * 200, "x" * 199 + "y", "𝒳z", "k" * 24]
    words += ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = []
    for _ in range(n):
        weights = [1 / (i + 1) for i in range(len(words))]
        text = "".join(w + rng.choice([" ", "1", "\n", "\x7f", "@"]) for w in rng.choices(words, weights, k=rng.randrange(30)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é3", None, "s4"])))
    return rows + rows[:20] + [("only here", "xx", "s1"), (None, "yy", "s1"), (None, "yy", "s2")]


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in d.divergence(df, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark):
    rows = documents(1, 400)
    assert result(spark, rows, min_docs=5, top=7) == brute_force(rows, 5, 7)


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    rows = documents(2, 200)
    monkeypatch.setattr(d, "TILE", 2)
    monkeypatch.setattr(d, "BLOCK_ROWS", 7)
    assert result(spark, rows, min_docs=4) == brute_force(rows, 4, 50)


def test_long_texts_count_once(spark):
    long = "word " * 700_000 + "end"
    rows = [(long, "en", "s1"), ("word end", "en", "s2"), ("z" * 100_000, "en", "s1"), ("Z" * 100_000, "en", "s2")]
    got = {(r[1], r[3]): r for r in result(spark, rows, min_docs=2) if r[2] == "term"}
    assert ("s1", "word") in got and ("s2", "z" * 100_000) in got
    assert result(spark, rows[:1], min_docs=2) == set()


def test_terms_with_one_number_are_told_apart():
    text = b"abcdefgh1 abcdefghi abcdefghj abcdefgh abcdefghi"
    data = np.frombuffer(text, np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[a-z]+", text)]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    batch = d._exact_counts(data, starts, ends - starts, np.zeros(5, np.int64), np.zeros(1, np.int64), [("en", "s")])
    got = {t: (k, n) for t, k, n in zip(*[batch.column(c).to_pylist() for c in ("term", "docs", "n")], strict=True)}
    assert got == {"abcdefgh": (1, 2), "abcdefghi": (1, 2), "abcdefghj": (1, 1)}


def test_empty_table(spark):
    assert d.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
