import pytest

from fleetlens.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size string, target int, part int"


def water_fill(sizes, weights, cap=3):
    """Targets by sharing again and again until none is above its cap."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        out = [cap * s if i in full else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(out) if t > cap * sizes[i] and i not in full}
        if not above:
            return out
        full |= above


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_targets_and_words_taken(spark):
    rows, sizes = [], [5, 300, 40, 12, 700, 90]
    for k, size in enumerate(sizes):
        rows += [(k * 1000 + i, "w " * min(7, size - 7 * i), f"s{k}") for i in range(-(-size // 7))]
    got = m.mix(docs(spark, rows).repartition(4)).collect()
    want = water_fill(sizes, [1, 2, 3, 1, 2, 3])
    for k, size in enumerate(sizes):
        mine = [r for r in got if r.source == f"s{k}"]
        assert {r.source_size for r in mine} == {size}
        assert {round(r.target, 6) for r in mine} == {round(want[k], 6)}
        assert abs(sum(r.taken for r in mine) - want[k]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sum(r.taken for r in got) == pytest.approx(sum(sizes), abs=3)


def test_reruns_and_partitionings_agree(spark, rows):
    df = docs(spark, [(i, "a b c " * (i % 9), f"s{i % 3}") for i in range(3000)])
    first = rows(m.mix(df), "doc_id", "taken")
    assert first == rows(m.mix(df.repartition(7)), "doc_id", "taken")


def test_odd_rows(spark):
    odd = [(1, None, "a"), (2, "", None), (2, "", None), (None, "x y", None), (4, "\t \x0b", "a"), (5, "long " * 5000, "b"), (5, "long " * 5000, "b")]
    got = m.mix(docs(spark, odd)).collect()
    assert len(got) == 7
    assert sorted(r.size for r in got) == [0, 0, 0, 0, 2, 5000, 5000]
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert m.mix(docs(spark, odd).where("doc_id < 0")).count() == 0
    empty = m.mix(docs(spark, [(1, None, "a")])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)]


def test_mixed_documents_keep_columns_and_repeat(spark):
    df = docs(spark, [(i, "w " * 10, "a" if i < 20 else "b") for i in range(220)])
    out = m.mixed_documents(df, weights=(1, 1))
    assert out.columns == df.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["a"] == 60 and abs(counts["b"] - 160) <= 1


@pytest.mark.parametrize("ids,texts", [("none", "equal"), ("none", "apart"), ("one", "equal"), ("one", "apart")])
def test_rows_without_or_with_one_id_come_as_often_as_budgeted(spark, ids, texts):
    """1,000 rows of two words that a third of the weights leave about 600 of."""
    doc_id = None if ids == "none" else 9
    rows = [(doc_id, "a b" if texts == "equal" else f"a b{i}", "a") for i in range(1000)]
    rows += [(i, "c " * 10, "b") for i in range(100, 200)]
    df = docs(spark, rows).repartition(6)
    taken = {r.source: r.taken for r in m.mix(df, weights=(2, 3)).groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    out = m.mixed_documents(df, weights=(2, 3))
    assert out.columns == df.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert taken["a"] == 1200 and counts["a"] == 600
    assert abs(counts["b"] * 10 - taken["b"]) <= 5


def test_rows_without_an_id_spread_over_ranges(spark):
    df = docs(spark, [(None, f"t{i}", "a") for i in range(6000)])
    plan = m.mix(df)
    assert plan.count() == 6000
    keys = df.select(m.hash_key(m.F.concat_ws(":", m.F.lit("mix"), m.F.lit("null"), m.F.md5("text"))).alias("k"))
    fullest = keys.groupBy(m.range_of(m.F.col("k"), m.F.lit(12))).count().agg({"count": "max"}).first()[0]
    assert fullest < 1000
