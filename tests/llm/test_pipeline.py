import random

import corpus_pipeline as p


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(6)
    syllables = ["an", "er", "on", "th", "re", "in", "es", "ti", "or", "al"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, base = text(40), text(150)
    rows = [(i, text(60), "en", f"s{i % 3}", 0, "x") for i in range(240)]
    toxic = range(0, 240, 6)
    rows = [(*r[:1], r[1] + " wretchfool" if r[0] in toxic else r[1], *r[2:]) for r in rows]
    rows += [(300, base, "en", "s0", 0, "x"), (301, base, "en", "s1", 0, "x"), (302, base + " end", "en", "s1", 0, "x")]
    rows += [(310, text(30) + " " + item.upper() + ". " + text(9), "en", "s2", 0, "x"), (320, None, None, None, None, None), (None, "", "en", None, 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.doc_id for r in docs.collect()]
    everything = {r[0] for r in rows}
    assert everything - set(seen["toxicity"]) == set(toxic)
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {301, 302}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {310}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and len(seen["mixing"]) > 150
    assert sorted(map(str, seen["sharding"])) == sorted(map(str, seen["mixing"]))


def test_run_over_the_small_tables(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "shard", "slot"} <= set(out.columns)
