import random
import re

from fleetlens.llm import line_rules as q

SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def judged(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return sorted(q.judge_lines(df).collect(), key=lambda r: r.doc_id)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "é", "c$", "#", "dd", "x y", "🙂"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", " \n\n", "\x0b"]) for _ in range(rng.randrange(160))) for _ in range(150)]
    texts += ["", " \n ", "one", "one two", "a b c", "a b c a b c", "w " * 3000, " ".join(map(str, range(5000)))]
    for text, r in zip(texts, judged(spark, texts), strict=True):
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_force(text), repr(text[:80])


def test_verdicts_by_line(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(15)) + "." for i in range(8))
    bars = "\n".join(" | ".join(f"i{i}n{j}" for j in range(9)) for i in range(8))
    shout = " ".join(f"W{i}!!" for i in range(80))
    symbols = " ".join(f"w{i}$$$" for i in range(80))
    flat = "\n".join(" ".join(f"v{i}x{j}" for j in range(20)) for i in range(5))
    licence = prose + "\nLicensed under the Some License.\nAll rights reserved"
    rows = judged(spark, [prose, bars, shout, symbols, flat, licence, prose + "\n" + bars, None])
    assert [r.kept for r in rows] == [True, False, False, False, False, True, True, False]
    assert rows[5].clean_text == prose and rows[5].n_failed_lines == 2
    assert rows[6].clean_text == prose and rows[7].n_words == 0


def test_line_ends_and_tabs_change_no_verdict(spark):
    line = " ".join(f"v{j}" for j in range(11))
    twelve = line + " v11"
    text = lambda one, end, lead: "".join(f"{lead}{one} n{i}x.{end}" if i < 9 else f"{lead}{one}{end}" for i in range(18))
    rows = judged(spark, [text(one, end, lead) for one in (line, twelve) for end in ("\n", "\r\n", " \r\n") for lead in ("", "\t", " ")])
    assert {r.n_failed_lines for r in rows[:9]} == {0} and {r.n_failed_lines for r in rows[9:]} == {9}


def test_repeated_rows_are_judged_alike(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1)] * 3 + [(None, "a b c", "x", 1)], SCHEMA)
    rows = q.judge_lines(df).drop("doc_id").collect()
    assert len(rows) == 4 and len(set(rows)) == 1


def test_empty_table(spark):
    assert judged(spark, ["x"])[0].base_failed
    assert q.judge_lines(spark.createDataFrame([], SCHEMA)).count() == 0
