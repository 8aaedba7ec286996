"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of the character n-grams (bytes 3 to 6, word borders included) of
its lower-cased letters and digits, so a misspelling shares most vectors with the word
it bends.  Word vectors are averages of n-gram vectors, a span of words averages its
words, and a linear softmax tells toxic from clean.  Embeddings and softmax are
trained jointly in numpy on a bounded sample of labelled rows, on the span of each
document that looks most toxic, because a label says only that some span is toxic:
in the first rounds by the log odds of its n-grams, then by the model itself.  A document scores as its worst span,
so one insult in a long text is seen, and the whole text is read.

The classifier is linear in the embeddings, so scoring needs one number per n-gram
bucket; that table has a fixed size and travels with the task.

Defined cases: a null, empty or wordless text scores as the bias alone says;
repeated rows score alike; without labels of both classes every text scores 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.labelled import held_out, labelled_sample
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import column_bytes, lower_table, mixed, row_groups

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 19
ORDERS = (3, 4, 5, 6)
DIM = 8
SPAN = 4  # words averaged together
REFRESH = 64  # training steps between two choices of the scores that pick spans
ROWS_PER_CLASS = 1200  # bound of the training sample
MAX_TRAIN_BYTES = 16384  # longer texts are not trained on; all are scored
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5


def folded() -> np.ndarray:
    """Byte map: letters lower-cased, digits and non-ASCII kept, all else a blank."""
    keep = lower_table()
    other = np.ones(256, bool)
    other[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    keep[other] = 32
    return keep


def spread(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with a blank before and after each; (bytes, first byte of each text)."""
    n = len(offsets) - 1
    places = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out = np.full(len(data) + n + 1, 32, np.uint8)
    out[places] = fold[data]
    return out, offsets[:-1] + np.arange(1, n + 1)


def word_grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of folded bytes and, per order, a bucket and a validity for every place.

    Place i stands for the n-gram of bytes i - 1 ... i + n - 2: it may hold the blank on
    either side of a word but never bytes of two words.
    """
    blank = text == 32
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    values = text.astype(np.uint64) + np.uint64(1)
    inner = np.cumsum(blank)  # equal at two places: no blank from the second byte on
    out = []
    for n in ORDERS:
        m = len(text) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, bool)))
            continue
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + values[k : k + m]
        bucket = (mixed(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        # blanks only as the first or the last byte
        out.append((bucket, inner[n - 2 : n - 2 + m] == inner[:m]))
    return starts, ends, out


def word_scores(text: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and score of every word: the mean score of its n-grams."""
    starts, ends, grams = word_grams(text)
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for n, (bucket, valid) in zip(ORDERS, grams, strict=True):
        m = len(bucket)
        sums = np.concatenate([[0.0], np.cumsum(np.where(valid, scalar[bucket], 0.0))])
        counts = np.concatenate([[0], np.cumsum(valid)])
        # n-grams from the blank before the word to the blank after it
        a, b = np.minimum(starts - 1, m), np.clip(ends + 2 - n, 0, m)
        b = np.maximum(a, b)
        total += sums[b] - sums[a]
        count += counts[b] - counts[a]
    return starts, total / np.maximum(count, 1)


def worst_spans(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest mean over SPAN words in a row of each text; all words if fewer; 0 without."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out = np.zeros(len(bounds) - 1)
    n = np.diff(bounds)
    few = np.flatnonzero((n > 0) & (n < SPAN))
    out[few] = (sums[bounds[few + 1]] - sums[bounds[few]]) / n[few]
    many = np.flatnonzero(n >= SPAN)
    if len(many):
        means = (sums[SPAN:] - sums[:-SPAN]) / SPAN
        # spans that begin after the last full one of a text belong to no text
        edges = np.stack([bounds[many], bounds[many + 1] - SPAN + 1], 1).ravel()
        out[many] = np.maximum.reduceat(np.append(means, -np.inf), edges)[::2]
    return out


def train(texts: list[str], y: list[int], *, seed: int = 1, steps: int = 24000, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Score per bucket and bias, from jointly trained embeddings and softmax."""
    rng = np.random.default_rng(seed)
    table_, weights, bias = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    scalar = lambda: table_ @ (weights[:, 1] - weights[:, 0])
    if len(set(y)) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), -30.0
    fold, docs, used = folded(), [], 0
    raws = [np.frombuffer(text.encode(), np.uint8) for text in texts]
    # one array for all n-grams: its memory goes back when it is done with
    store = np.empty(len(ORDERS) * sum(len(raw) + 2 for raw in raws), np.int32)
    for raw in raws:
        starts, ends, grams = word_grams(spread(raw, np.array([0, len(raw)]), fold)[0])
        ids, owner = [], []
        for n, (bucket, valid) in zip(ORDERS, grams, strict=True):
            place = np.flatnonzero(valid & (bucket >= 0))
            # the first letter of the n-gram is at its place or one further
            word = np.searchsorted(starts, place + 1, "right") - 1
            good = (word >= 0) & (place + n <= ends[np.maximum(word, 0)] + 1) if len(starts) else np.zeros(len(place), bool)
            ids.append(bucket[place[good]])
            owner.append(word[good])
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        mine = store[used : used + len(ids)]
        mine[:] = ids[order]
        used += len(ids)
        docs.append((mine, np.searchsorted(owner[order], np.arange(len(starts) + 1)).astype(np.int32)))
    label = np.array(y)

    def step(ids: np.ndarray, share: np.ndarray, k: int, lr: float) -> None:
        hidden = share @ table_[ids]
        logits = hidden @ weights + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[k] -= 1
        back = weights @ p
        weights[:] -= lr * 0.1 * np.outer(hidden, p)
        bias[:] -= lr * 0.1 * p
        np.add.at(table_, ids, -lr * 10 * share[:, None] * back)

    # log odds of the documents that hold an n-gram bucket
    held = np.full((2, 1 << BUCKET_BITS), 0.5)
    for (ids, _), k in zip(docs, label, strict=True):
        held[k, np.unique(ids)] += 1
    odds = np.log(held[1] / (label.sum() + 1)) - np.log(held[0] / ((1 - label).sum() + 1))
    rounds = max(6, -(-steps // len(docs)))
    for turn in range(rounds):
        lr = rate * (1 - turn / rounds)
        for at, i in enumerate(rng.permutation(len(docs))):
            if at % REFRESH == 0:
                current = odds if turn < 2 else scalar()
            ids, cuts = docs[i]
            n = len(cuts) - 1
            if not n:
                continue
            sizes = np.maximum(np.diff(cuts), 1)
            words = np.concatenate([[0.0], np.cumsum(current[ids])])
            words = (words[cuts[1:]] - words[cuts[:-1]]) / sizes
            w = min(SPAN, n)
            run = np.concatenate([[0.0], np.cumsum(words)])
            a = int(np.argmax(run[w:] - run[:-w]))
            b = a + w
            step(ids[cuts[a] : cuts[b]], np.repeat(1 / sizes[a:b] / (b - a), np.diff(cuts[a : b + 1])), label[i], lr)
    return scalar().astype(np.float32), float(bias[1] - bias[0])


def scorer(scalar: np.ndarray, bias: float):
    """Task function: doc_id and text in, doc_id and score out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = folded()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            out = np.zeros(len(offsets) - 1)
            for i, j in row_groups(offsets):
                text, first = spread(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold)
                starts, words = word_scores(text, scalar)
                bounds = np.append(np.searchsorted(starts, first), len(starts))
                out[i:j] = worst_spans(words, bounds)
            p = 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p)], names=[*names, "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on at most ``ROWS_PER_CLASS`` rows of each class, collected to the driver."""
    sample = labelled_sample(
        docs, labels, "toxic", rows_per_class=ROWS_PER_CLASS, max_bytes=MAX_TRAIN_BYTES, folds=FOLDS, fold=FOLD
    ).collect()
    return train([r.text for r in sample], [r.y for r in sample])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document.

    Reads ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``toxic`` of ``labels``.  Returns
    doc_id, held_out, score (0 to 1) and predicted (score >= 0.5).
    """
    scalar, bias = fit(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(scorer(scalar, bias), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
