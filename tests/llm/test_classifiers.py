"""Held-out accuracy, and defined results for odd rows, of the three text classifiers."""

import random
import zlib

import numpy as np
import pytest

from fleetlens.llm import langid, quality, toxicity
from fleetlens.llm.labelled import labelled_sample

SF_DIR = "/root/testdata/sf0.01"
ODD = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "word " * 60_000), (900_005, "x" * 300_000), (None, "a null id"), (900_006, "12 !? 34"), (900_006, "12 !? 34")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], docs.schema)
    return docs.unionByName(odd), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def rates(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def check_odd(rows, name="score"):
    odd = [r for r in rows if r.doc_id is None or r.doc_id > 900_000]
    assert len(odd) == len(ODD) and all(0 <= r[name] <= 1 for r in rows)
    return {r.doc_id: r for r in odd}


def test_quality(tables):
    docs, labels = tables
    rows = quality.quality(docs, labels).collect()
    assert rates(rows, labels, "quality") > 0.97
    check_odd(rows)


def test_toxicity(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert rates(rows, labels, "toxic") > 0.94
    odd = check_odd(rows)
    assert odd[900_001].score == odd[900_002].score == odd[900_003].score and odd[900_001].predicted == 0


def test_toxicity_sees_misspelt_words_in_long_texts():
    rng = random.Random(4)
    syllables = ["an", "er", "on", "th", "re", "in", "es", "ti", "or", "al", "mo", "ka"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    bad = ["wretchfool", "grumblehead", "slugbrain"]
    texts, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.choice([5, 30, 200]))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    scalar, bias = toxicity.train(texts, labels)
    import pyarrow as pa

    def score(many):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(many))), "text": many})
        return next(iter(toxicity.scorer(scalar, bias)([batch]))).column("score").to_pylist()

    clean = [" ".join(word() for _ in range(4000)) for _ in range(10)]
    assert max(score(clean)) < 0.5
    for near in ("wretchfol", "grumbleheads", "slugbrains", "WretchFool!"):
        assert min(score([t[:9000] + f" {near} " + t[9000:] for t in clean])) > 0.5, near


def test_language(tables):
    docs, _ = tables
    rows = langid.languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect() if r.lang}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    odd = check_odd(rows)
    assert [odd[i].lang_pred for i in (900_001, 900_002, 900_003, 900_006)] == ["und"] * 4
    assert odd[900_001].score == 0 and odd[900_004].lang_pred != "und"


def test_word_probability_sums_all_segmentations():
    pieces = sorted({bytes([langid.MARK]), b"a", b"b", b"ab", b"ba", b"aba", bytes([langid.MARK]) + b"a"})
    p = np.random.default_rng(1).random((len(pieces) + 1, 2))
    p[-1] = 0
    data = np.frombuffer(b"abaab", np.uint8)
    ids = langid.piece_ids(langid.word_matrix(data, np.array([0]), np.array([5])), langid.Pieces(pieces))
    word = bytes([langid.MARK]) + b"abaab"

    def total(at, lang):
        if at == len(word):
            return 1.0
        return sum(p[i, lang] * total(at + len(x), lang) for i, x in enumerate(pieces) if word.startswith(x, at))

    got = langid.forward(ids, p)[0, 6]
    assert np.allclose(got, [total(0, 0), total(0, 1)])
    counts = langid.expected_counts(ids, np.array([6]), np.ones((1, 2)), p)
    lengths = np.array([len(x) for x in pieces])
    assert np.allclose((counts[:-1] * lengths[:, None]).sum(0), 6)  # every byte is in one piece


def test_long_pieces_and_long_words_are_summed_whole():
    """Pieces of any length, words of any length: equal to a plain recursion in logarithms."""
    assert {b"\x01information", b"springframework", b"\x01responsibility"} <= set(langid.vocabulary())
    rng = np.random.default_rng(2)
    singles = {bytes([b]) for b in range(1, 256)}
    longer = {b"\x01abcabcabcabc", b"bcabcabca", b"cab", "語言語言".encode(), "言語".encode(), ("言" * 8).encode()}
    pieces = sorted(singles | longer)
    p = rng.random((len(pieces) + 1, 2)) * 1e-6
    p[[*map(pieces.index, longer)]] = rng.random((len(longer), 2))
    p[-1] = 0
    words = ["abcabcabcabc", "言語言語", "abc" * 200, "語言" * 300, "x" + "言" * 4001, "a", "b" * 31, "b" * 32, "b" * 33]
    number = {x: i for i, x in enumerate(pieces)}
    want = []
    for word in words:
        marked = bytes([langid.MARK]) + word.encode()
        la = [np.zeros(2)]
        for j in range(1, len(marked) + 1):
            ways = [la[j - k] + np.log(p[number[marked[j - k : j]]]) for k in range(1, min(j, 24) + 1) if marked[j - k : j] in number]
            la.append(np.logaddexp.reduce(ways))
        want.append(la[-1])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    lengths = np.array([len(w.encode()) for w in words])
    trie = langid.Pieces(pieces)
    got = langid.log_words(data, np.cumsum(lengths) - lengths, lengths, trie, p)
    assert np.allclose(got, want, rtol=1e-9)
    ids = langid.piece_ids(langid.word_matrix(data, np.cumsum(lengths) - lengths, lengths), trie)
    counts = langid.expected_counts(ids, lengths + 1, np.ones((len(words), 2)), p)
    sizes = np.array([len(x) for x in pieces])
    assert np.allclose((counts[:-1] * sizes[:, None]).sum(0), (lengths + 1).sum())


def test_empty_tables_and_missing_labels(spark, tables):
    docs, labels = tables
    none, few = labels.limit(0), docs.limit(20)
    assert max(r.score for r in toxicity.toxicity(few, none).collect()) < 1e-9
    assert {r.score for r in quality.quality(few, none).collect()} == {0.5}
    assert {r.lang_pred for r in langid.languages(few.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    assert quality.quality(docs.limit(0), none).count() == 0
    assert langid.languages(docs.limit(0)).count() == 0


def test_sample_is_bounded_and_repeatable(tables):
    docs, labels = tables
    kw = dict(rows_per_class=20, max_bytes=5000, folds=5, fold=0)
    one = labelled_sample(docs, labels, "quality", **kw).collect()
    assert len(one) <= 40 and one == labelled_sample(docs.repartition(5), labels, "quality", **kw).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 and len(r.text.encode()) <= 5000 for r in one)
