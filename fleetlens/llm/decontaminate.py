"""Benchmark decontamination: SimHash over item-sized windows, then exact similarity.

For each benchmark item the windows of a document that are as long as the item are its
candidates; a document shorter than the item is one window as a whole.  A window's fingerprint is a SimHash of its word shingles, each weighted by
how often it occurs; fingerprints are compared through a multi-index: cut into blocks, so that two
fingerprints within the radius must be near in at least one block (if every block differed
by more than its share, the sum would pass the radius).  What the index returns within
the radius is verified exactly by the weighted Jaccard similarity (the sum of the lesser counts over that of the greater).

A window that shares no shingle with any item has similarity 0, so fingerprints are only
taken where one does; everything else about the document is skipped without loss.

The benchmark travels with the tasks in parts of a fixed size, one pass over the
documents per part.

Defined cases: null, empty or blank texts have no windows; items of fewer words than a
shingle use the whole item as one; an item without words matches nothing; repeated items
match each on its own; repeated documents match alike; a null item_id or doc_id is
returned as null; empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.joins import small_side
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import WordHasher, column_bytes, shingle_hashes
from fleetlens.session import cut

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 8
RADIUS = 23  # of 64 bits: 2 in one of the eight 8-bit blocks at least
PART_ITEMS = 20_000  # items that travel together


def word_space() -> np.ndarray:
    """Bytes that separate words: ASCII but letters and digits, so punctuation never hides a copy."""
    blank = np.zeros(256, bool)
    blank[:128] = True
    blank[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return blank


def bits_of(h: np.ndarray) -> np.ndarray:
    """Each hash as 64 numbers, +1 or -1."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as 8 bytes each, from sums of the 64 numbers."""
    return np.packbits(sums > 0, axis=1)


class Items:
    """Shingles, weights, fingerprints and multi-index of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        hasher = WordHasher(lower=True, space=word_space())
        h, _, _, bounds = hasher.words(*column_bytes(pa.array(texts, pa.string())))
        self.ids, self.words, self.shingles = [], [], []
        for i, item in enumerate(ids):
            words = h[bounds[i] : bounds[i + 1]]
            if len(words):
                self.ids.append(item)
                self.words.append(len(words))
                self.shingles.append(shingle_hashes(words, min(SHINGLE, len(words))))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        self.totals = np.array([len(s) for s in self.shingles])
        self.by_words: dict[int, list[int]] = {}
        for i, n in enumerate(self.words):
            self.by_words.setdefault(n, []).append(i)
        self.prints = np.array([
            simhash(bits_of(s).sum(0, keepdims=True))[0] for s in self.shingles
        ], np.uint8).reshape(-1, BITS // 8)
        # bits in which two bytes differ
        pop = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
        self.distance = pop[np.arange(256)[:, None] ^ np.arange(256)]
        # per length of item and block: which items a byte value may belong to
        share = RADIUS // BLOCKS
        self.index = {
            n: [self.distance[self.prints[members, b]] <= share for b in range(BLOCKS)] for n, members in self.by_words.items()
        }

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Jaccard similarity of two shingle multisets: a shingle weighs what it occurs."""
        a, n = np.unique(self.shingles[item], return_counts=True)
        b, m = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = int(np.minimum(n[i], m[j]).sum())
        return common / (len(self.shingles[item]) + len(window) - common)

    def _windows(self, part: np.ndarray, hits: np.ndarray, lo: int, size: int, lengths: list[int], best: dict, whole: bool) -> None:
        """Compare the windows of a stretch that hold a hit with the items of their length."""
        known = np.zeros(len(part), bool)
        known[hits] = True
        sums = np.zeros((len(part) + 1, BITS), np.int32)
        np.cumsum(bits_of(part), axis=0, out=sums[1:])
        held = np.concatenate([[0], np.cumsum(known)])
        for n in lengths:
            # a document shorter than the item comes as one stretch and is one window
            inside, members = min(n - size + 1, len(part)) if whole else n - size + 1, np.array(self.by_words[n])
            if inside > len(part):
                continue
            starts = np.flatnonzero(held[inside:] > held[:-inside])
            prints = simhash(sums[starts + inside] - sums[starts])
            near = np.zeros((len(members), len(starts)), bool)
            for b in range(BLOCKS):
                near |= self.index[n][b][:, prints[:, b]]
            of, at = np.nonzero(near)
            of = members[of]
            close = self.distance[self.prints[of], prints[at]].sum(1) <= RADIUS
            # the common weight is at most that of the known shingles, the union at least the item's
            bound = (held[inside:] - held[:-inside])[starts[at]] / self.totals[of]
            close = np.flatnonzero(close & (bound >= SIMILARITY))
            close = close[np.argsort(-bound[close], kind="stable")]
            for item, start, top in zip(of[close].tolist(), starts[at[close]].tolist(), bound[close].tolist(), strict=True):
                if top <= best.get(item, (0.0, 0))[0]:
                    continue
                s = self.similarity(item, part[start : start + inside])
                if s >= SIMILARITY and s > best.get(item, (0.0, 0))[0]:
                    best[item] = (s, lo + start)

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of each item in one text."""
        best: dict[int, tuple[float, int]] = {}
        # of two shingle multisets the smaller bounds the similarity: much longer items cannot match
        lengths = [
            n for n in self.by_words
            if n <= len(words) or len(words) - (k := min(SHINGLE, n)) + 1 >= max(1, SIMILARITY * (n - k + 1))
        ]
        for size in sorted({min(SHINGLE, n) for n in lengths}):
            shingles = shingle_hashes(words, size)
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            hits = np.flatnonzero(self.known[at] == shingles)
            if not len(hits):
                continue
            mine = [n for n in lengths if min(SHINGLE, n) == size]
            reach = max(mine)
            # hits near each other are worked on together, with room for the longest window
            for run in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
                lo, hi = max(0, int(run[0]) - reach), min(len(shingles), int(run[-1]) + reach)
                self._windows(shingles[lo:hi], run - lo, lo, size, mine, best, hi - lo == len(shingles))
        return [(i, s, start) for i, (s, start) in sorted(best.items())]


def _find(items: Items):
    """Task function: doc_id and text in, a row per matched item out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True, space=word_space())
        sizes = sorted({min(SHINGLE, n) for n in items.words})
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                h, _, _, bounds = hasher.words(*column_bytes(batch.column("text")))
                known = np.zeros(len(h) + 1, bool)
                for size in sizes if len(items.known) else []:
                    s = shingle_hashes(h, size)
                    at = np.minimum(np.searchsorted(items.known, s), len(items.known) - 1)
                    known[: len(s)] |= items.known[at] == s
                hits = np.concatenate([[0], np.cumsum(known)])
                picked = np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]])
                out: list[tuple] = []
                for i in picked.tolist():
                    for item, s, start in items.matches(h[bounds[i] : bounds[i + 1]]):
                        out.append((i, items.ids[item], s, start, min(items.words[item], int(bounds[i + 1] - bounds[i]))))
                cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(cols[0], pa.int64())),
                        pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                        pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, *, part_items: int = PART_ITEMS) -> DataFrame:
    """Benchmark items found in documents.

    Reads ``doc_id``, ``text`` of ``docs`` and ``item_id``, ``text`` of ``benchmark``.  Returns a row
    per document and item whose best window has a similarity of 0.8 or more: doc_id, item_id,
    similarity, first_word and n_words (of the window).
    """
    parts = max(1, -(-benchmark.count() // part_items))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = None
    for k in range(parts):
        rows = benchmark.where(part == k).select("item_id", "text").orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        one = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(
            _find(items), "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
        )
        found = one if found is None else found.unionByName(one)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item; columns as given."""
    bad = small_side(cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct()))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
