"""Quality classifier: naive Bayes support vectors.

A document is the set of its character n-grams (bytes 1 to 4, hashed) and of steps of
its repetition (the share of 3-word windows seen before), all as indicators.  Each
indicator is scaled by the log ratio of its smoothed frequencies in the two
classes, which are counted over every labelled training row on the cluster, and a
linear hinge-loss model over the scaled, length-normalised indicators is fitted by
dual coordinate descent on a bounded sample.  Every whole text is scored.

Defined cases: a null, empty or blank text has no indicators and scores as the bias
says; repeated rows score alike; without labels of both classes every text scores
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.joins import small_side
from fleetlens.llm.labelled import held_out, labelled_sample
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import PIECE, WordHasher, column_bytes, mixed, shingle_hashes
from fleetlens.session import cut

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 16
ORDERS = (1, 2, 3, 4)
REPEAT_STEPS = tuple(range(5, 100, 5))  # percent of repeated windows; one indicator each
FEATURES = (1 << BUCKET_BITS) + len(REPEAT_STEPS)
ROWS_PER_CLASS = 1500  # bound of the sample for the hinge-loss fit
MAX_TRAIN_BYTES = 32768  # longer texts are not fitted on; all are counted and scored
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
SLOPE = 3.0  # of the logistic curve from margins to scores


def indicators(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Ids of the indicators that hold for one text, given its bytes and word hashes."""
    seen = np.zeros(FEATURES, bool)
    for a in range(0, len(data), PIECE):
        piece = data[a : a + PIECE + ORDERS[-1] - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(piece), np.uint64)
        for n in ORDERS:
            m = len(piece) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + piece[n - 1 :]
            seen[(mixed(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] = True
    windows = shingle_hashes(hashes, 3)
    if len(windows):
        again = 100 * (len(windows) - len(np.unique(windows))) / len(windows)
        seen[1 << BUCKET_BITS :] = again >= np.array(REPEAT_STEPS)
    return np.flatnonzero(seen)


def rows_indicators(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[np.ndarray]:
    data, offsets = column_bytes(batch.column("text"))
    hashes, _, _, bounds = hasher.words(data, offsets)
    for i in range(len(offsets) - 1):
        yield indicators(data[offsets[i] : offsets[i + 1]], hashes[bounds[i] : bounds[i + 1]])


def count_indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: documents per indicator and class."""
    hasher, counts, rows = WordHasher(lower=False), np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for y, ids in zip(batch.column("y").to_pylist(), rows_indicators(batch, hasher), strict=True):
            counts[y, ids] += 1
            rows[y] += 1
    if rows.sum():
        used = np.flatnonzero(counts.sum(0))
        ids = np.append(used, -1)  # -1: all documents
        zero, one = np.append(counts[0, used], rows[0]), np.append(counts[1, used], rows[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(zero), pa.array(one)], names=["f", "zero", "one"])


def dual_coordinate_descent(
    rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, cost: float = 1.0, rounds: int = 12, seed: int = 1
) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum of hinge losses, classes weighted alike."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[r] / max(np.sqrt(np.sum(ratio[r] ** 2)), 1e-9) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    sign = np.where(y == 1, 1.0, -1.0)
    bound = np.where(y == 1, cost * len(y) / (2 * max(1, (y == 1).sum())), cost * len(y) / (2 * max(1, (y == 0).sum())))
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                w[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
    return w, bias


def scorer(ratio: np.ndarray, weights: np.ndarray, bias: float):
    """Task function: doc_id and text in, doc_id and score out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, product, square = WordHasher(lower=False), ratio * weights, ratio**2
        for batch in batches:
            margins = [
                product[ids].sum() / max(np.sqrt(square[ids].sum()), 1e-9) for ids in rows_indicators(batch, hasher)
            ]
            p = 1 / (1 + np.exp(-SLOPE * (np.array(margins, np.float64) + bias)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return score


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log-count ratio of every indicator over all labelled training rows.

    The sums are made on the cluster; the table that comes back has a fixed size.
    """
    ids = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, FOLD))
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
    )
    ids = small_side(cut(ids))  # measured: beyond the limit the texts are shuffled
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").select("y", "text")
    counts = rows.mapInArrow(count_indicators, "f bigint, zero bigint, one bigint")
    found = counts.groupBy("f").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
    found = pd.DataFrame(found).set_index("f")
    if -1 not in found.index:
        return np.zeros(FEATURES)
    n = found.loc[-1]
    table_ = np.zeros((2, FEATURES))
    at = found.index[found.index >= 0].to_numpy()
    table_[0, at], table_[1, at] = found.loc[at, "zero"], found.loc[at, "one"]
    return np.log((table_[1] + 1) / (n.one + 2)) - np.log((table_[0] + 1) / (n.zero + 2))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios over all rows, then weights on at most ``ROWS_PER_CLASS`` rows of each class."""
    ratio = log_ratio(docs, labels)
    sample = labelled_sample(
        docs, labels, "quality", rows_per_class=ROWS_PER_CLASS, max_bytes=MAX_TRAIN_BYTES, folds=FOLDS, fold=FOLD
    ).collect()
    y = np.array([r.y for r in sample], int)
    if len(set(y.tolist())) < 2:
        return ratio, np.zeros(FEATURES), 0.0
    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in sample])], names=["text"])
    rows = list(rows_indicators(batch, WordHasher(lower=False)))
    return ratio, *dual_coordinate_descent(rows, y, ratio)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document.

    Reads ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``quality`` of ``labels``.  Returns
    doc_id, held_out, score (0 to 1) and predicted (score >= 0.3).
    """
    scored = docs.select("doc_id", "text").mapInArrow(scorer(*fit(docs, labels)), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query("op3_quality")
def op3_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
