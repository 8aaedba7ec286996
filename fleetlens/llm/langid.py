"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary are cut out of words in every possible way.  A
language gives each piece a probability, a segmentation multiplies those of its pieces,
and a word's probability is the sum over all its segmentations, which a forward
pass computes in time linear in the word; a long word is passed in stretches that carry
the last values on, scaled, so a word may have any length.  Piece probabilities come from expectation
maximisation (expected piece counts from forward and backward passes) over a bounded
sample of labelled texts per language.  A text is the product of its words, so the
score reads the whole text; each distinct word of a batch is worked out once.

Words are runs of letters (lower-cased in ASCII), marked at the front; single bytes are
pieces too, so no word has probability 0.

Defined cases: a text without a letter (null, empty) is ``und`` with score 0; repeated
rows agree; with no labelled row at all everything is ``und``; an empty table gives an
empty result.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.labelled import held_out
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import WordHasher, column_bytes, lower_table

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 1  # byte before a word
ROWS_PER_LANGUAGE = 300  # bound of the training sample, about
MAX_TRAIN_BYTES = 16384  # longer texts are not trained on; all are scored
ROUNDS = 3
SMOOTHING = 0.05
FOLDS, FOLD = 3, 1
UNKNOWN = "und"
WORD_BLOCK = 20000  # distinct words worked on together
STRETCH = 32  # bytes of a word between two scalings; 32 single bytes do not underflow


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Lower-cased letter pieces of the vocabulary and all single bytes, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(1, 256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_byte(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        word = text.removeprefix("▁").lower()
        if word and word.isalpha():
            pieces.add((bytes([MARK]) if text.startswith("▁") else b"") + word.encode())
    return sorted(pieces)


def letters_space() -> np.ndarray:
    """Bytes that end a word: all ASCII but letters."""
    blank = np.zeros(256, bool)
    blank[:128] = True
    blank[[*range(65, 91), *range(97, 123)]] = False
    return blank


class Pieces:
    """Trie of the pieces: each prefix is a node, found by its parent and last byte."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        lengths = np.array([len(x) for x in pieces])
        self.longest = int(lengths.max())
        chars = np.zeros((self.n, self.longest), np.int64)
        chars[np.arange(self.longest) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        node, edges, self.piece = np.zeros(self.n, np.int64), [], [np.array([self.n])]
        size = 1
        for k in range(self.longest):
            inside = np.flatnonzero(lengths > k)
            edge, number = np.unique(node[inside] << 8 | chars[inside, k], return_inverse=True)
            node[inside] = size + number
            self.piece.append(np.full(len(edge), self.n))
            ends = inside[lengths[inside] == k + 1]
            self.piece[-1][node[ends] - size] = ends
            size += len(edge)
            edges.append(edge)
        # parents of a level come after those of the level before, so all edges are in order
        self.edges = np.concatenate(edges)
        self.piece = np.concatenate(self.piece).astype(np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child by that byte, or 0 where there is none."""
        edge = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, at + 1, 0)


def word_matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """Marked words as rows of bytes, padded with 0: their bytes from a to b, all if not given."""
    width = int(lengths.max()) + 1 if len(lengths) else 1
    place = np.arange(a, width if b is None else min(b, width))
    chars = data[np.clip(starts[:, None] + place - 1, 0, max(len(data) - 1, 0))]
    chars[place > lengths[:, None]] = 0
    chars[:, place == 0] = MARK
    return chars


def piece_ids(chars: np.ndarray, pieces: Pieces) -> np.ndarray:
    """ids[w, j, k]: the piece of word w that ends before byte j + 1 and has k + 1 bytes."""
    n, width = chars.shape
    ids = np.full((n, width, min(pieces.longest, width)), pieces.n, np.int32)
    word, at = np.nonzero(chars)
    node = np.zeros(len(word), np.int64)
    for k in range(ids.shape[2]):
        node = pieces.step(node, chars[word, at].astype(np.int64))
        word, at, node = word[node > 0], at[node > 0], node[node > 0]
        ids[word, at, k] = pieces.piece[node]
        more = at + 1 < width
        word, at, node = word[more], at[more] + 1, node[more]
    return ids


def forward(ids: np.ndarray, p: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """alpha[w, j, l]: probability in language l of the first j bytes; p has a last row of 0.

    ``before`` holds the values of the bytes before, the last of them for no byte of ids.
    """
    n, width, most = ids.shape
    back = 0 if before is None else before.shape[1] - 1
    alpha = np.zeros((n, back + width + 1, p.shape[1]))
    alpha[:, : back + 1] = 1 if before is None else before
    held = (ids < len(p) - 1).any(0)
    for j in range(width):
        for k in np.flatnonzero(held[j, : min(back + j + 1, most)]).tolist():
            alpha[:, back + j + 1] += alpha[:, back + j - k] * p[ids[:, j, k]]
    return alpha[:, back:]


def log_forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the values of ``forward`` for words of any length."""
    n, width, most = ids.shape
    out = np.full((n, width + 1, p.shape[1]), -np.inf)
    out[:, 0] = 0
    for a in range(0, width, STRETCH):
        b, first = min(a + STRETCH, width), max(0, a - most + 1)
        scale = np.where(np.isfinite(out[:, a]), out[:, a], 0)  # behind a word's end all is 0
        part = forward(ids[:, a:b], p, np.exp(out[:, first : a + 1] - scale[:, None]))
        with np.errstate(divide="ignore"):
            out[:, a + 1 : b + 1] = np.log(part[:, 1:]) + scale[:, None]
    return out


def expected_counts(ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language over words with weights[w, l]."""
    n, width, most = ids.shape
    rows = np.arange(n)
    alpha = log_forward(ids, p)
    # the backward pass is the forward pass of the words read from their ends
    back, k = np.arange(width)[:, None], np.arange(most)
    at = lengths[:, None, None] - 1 - back + k
    ok = (k <= back) & (back < lengths[:, None, None])
    beta = log_forward(np.where(ok, ids[rows[:, None, None], np.clip(at, 0, width - 1), k], len(p) - 1), p)
    left = lengths[:, None] - np.arange(width + 1)
    beta = np.where(left[..., None] >= 0, beta[rows[:, None], np.maximum(left, 0)], -np.inf)
    beta -= alpha[rows, lengths][:, None]
    counts = np.zeros_like(p)
    held = (ids < len(p) - 1).any(0)
    for j in range(width):
        for k in np.flatnonzero(held[j, : j + 1]).tolist():
            used = np.exp(alpha[:, j - k] + beta[:, j + 1]) * p[ids[:, j, k]] * weights
            for lang in range(p.shape[1]):
                counts[:, lang] += np.bincount(ids[:, j, k], used[:, lang], len(p))
    return counts


def log_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table_: Pieces, p: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word per language, a stretch of all words at a time."""
    out = np.zeros((len(starts), p.shape[1]))
    on, before = np.arange(len(starts)), np.ones((len(starts), 1, p.shape[1]))
    for a in range(0, int(lengths.max()) + 1, STRETCH):
        first = max(0, a - table_.longest + 1)
        ids = piece_ids(word_matrix(data, starts[on], lengths[on], first, a + STRETCH), table_)[:, a - first :]
        alpha = forward(ids, p, before)
        last = alpha[np.arange(len(on)), np.minimum(lengths[on] + 1 - a, STRETCH)]
        out[on] += np.log(last)
        more = lengths[on] + 1 > a + STRETCH
        before = np.concatenate([before[more, :-1], alpha[more]], 1)[:, -table_.longest :] / last[more, None]
        on = on[more]
        if not len(on):
            break
    return out


def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Words of similar length together, at most about WORD_BLOCK * 12 bytes."""
    order, a = np.argsort(lengths, kind="stable"), 0
    while a < len(order):
        b = min(a + WORD_BLOCK, len(order))
        while b > a + 1 and (b - a) * int(lengths[order[b - 1]]) > 12 * WORD_BLOCK:
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def distinct_words(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first byte and length of the distinct words; words of the texts by number, bounds."""
    data, offsets = column_bytes(texts)
    hashes, firsts, lasts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, edges in hasher.pieces(data, offsets):
        if a < b:
            first, last = hasher.spans(data[a:b], edges)
            hashes.append(hasher.hash_spans(data[a:b], first, last))
            firsts.append(first + a)
            lasts.append(last + a)
    starts, ends = np.concatenate(firsts), np.concatenate(lasts)
    _, at, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return lower_table()[data], starts[at], ends[at] - starts[at], number, np.searchsorted(starts, offsets)


def train(texts: list[str], langs: list[str], path: str = VOCABULARY) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, pieces and piece probabilities (one row more than pieces, of 0)."""
    names, pieces = sorted(set(langs)), vocabulary(path)
    table_ = Pieces(pieces)
    data, starts, lengths, number, bounds = distinct_words(pa.array(texts), WordHasher(lower=True, space=letters_space()))
    weights = np.zeros((len(starts), len(names)))
    for i, lang in enumerate(langs):
        np.add.at(weights[:, names.index(lang)], number[bounds[i] : bounds[i + 1]], 1)
    p = np.full((len(pieces) + 1, len(names)), 1 / len(pieces))
    p[-1] = 0
    for _ in range(ROUNDS):
        counts = np.zeros_like(p)
        for rows in blocks(lengths):
            ids = piece_ids(word_matrix(data, starts[rows], lengths[rows]), table_)
            counts += expected_counts(ids, lengths[rows] + 1, weights[rows], p)
        p[:-1] = (counts[:-1] + SMOOTHING) / (counts[:-1].sum(0) + SMOOTHING * len(pieces))
    return names, pieces, p


def scorer(names: list[str], pieces: list[bytes], p: np.ndarray):
    """Task function: doc_id, text and letters in; doc_id, lang_pred and score out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, hasher = Pieces(pieces), WordHasher(lower=True, space=letters_space())
        for batch in batches:
            data, starts, lengths, number, bounds = distinct_words(batch.column("text"), hasher)
            logs = np.zeros((len(starts), len(names)))
            for rows in blocks(np.minimum(lengths, STRETCH + table_.longest)):
                logs[rows] = log_words(data, starts[rows], lengths[rows], table_, p)
            totals = np.zeros((len(bounds) - 1, len(names)))
            for lang in range(len(names)):
                sums = np.concatenate([[0.0], np.cumsum(logs[number, lang])])
                totals[:, lang] = sums[bounds[1:]] - sums[bounds[:-1]]
            best = totals.argmax(1)
            share = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], pa.string()),
                    pa.array(np.where(letters, share, 0.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return score


def training_rows(docs: DataFrame) -> DataFrame:
    """About ``ROWS_PER_LANGUAGE`` labelled texts of each language, by a hash of the row.

    A language's share of its rows is its bound over its count, so no group is sorted
    or gathered; the counts are one row per language.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAIN_BYTES)
        & ~held_out(F.col("doc_id"), FOLDS, FOLD)
    )
    counts = Counter({r.lang: r["count"] for r in rows.groupBy("lang").count().collect()})
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (draw < min(1.0, ROWS_PER_LANGUAGE / n)))
    return rows.where(keep).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "lang")


def languages(docs: DataFrame, *, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Predicted language of every document.

    Reads ``doc_id``, ``text``, ``lang``.  Returns doc_id, held_out, lang_pred and score (the
    predicted language's share of the likelihood).
    """
    sample = training_rows(docs).collect()
    out = F.lit(UNKNOWN)
    if not sample:
        scored = docs.select("doc_id", out.alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        model = train([r.text for r in sample], [r.lang for r in sample], vocabulary_path)
        rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
        scored = rows.mapInArrow(scorer(*model), "doc_id bigint, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score")


@query("op9_language")
def op9_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))
