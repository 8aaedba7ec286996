"""How the sources of a language differ in their words: iceberg counts by growing prefixes.

A term is frequent if enough documents of its language hold it, and so is then every prefix
of it.  Each level reads the texts once and counts, for every prefix of a certain number of
bytes, the documents that hold it; a term takes part only if its prefix of the level before
was frequent.  Terms no longer than the prefix are complete and counted as such.  The
lengths double from level to level, until no frequent prefix is left open.  Rare terms are
thus never carried about; only at the end are the terms themselves counted, by source.

Prefixes are counted by 64-bit keys.  Two prefixes with one key add up, so a key can only
be kept too long.  The frequent keys of a level are held in a bit map of fixed size, whatever
their number; a bit set by another key does no harm either, because the last step counts
the terms themselves.  The counts are exact.

Sources are compared by blocks of terms and tiles of sources: a task gets the terms of one
block for two tiles, and gives one partial sum a pair of sources, so neither a frequent term
nor a large source fills a task, and no pairs are formed inside a term.

Defined cases: null text, lang and source are empty; an empty text has no terms, but its
group takes part; every row is a document of its own, repeated rows and ids included; a
term or text may have any length; a language without frequent terms gives value 0 for its
pairs and no terms; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.joins import small_side
from fleetlens.llm.registry import query, table
from fleetlens.llm.textbytes import WordHasher, column_bytes, mixed, row_groups
from fleetlens.session import cut

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 30
FIRST = 6  # bytes of the first prefix
MAP_BITS = 26  # the bit maps take 2**26 bits = 8 MiB
GROUP_BYTES = 1 << 21
BLOCK_ROWS = 100_000  # counts of a block of terms
TILE = 128  # sources of a tile
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5


def term_gaps() -> np.ndarray:
    """Bytes that no term holds: ASCII without letters."""
    gaps = np.zeros(256, bool)
    gaps[:128] = True
    gaps[[*range(65, 91), *range(97, 123)]] = False
    return gaps


def group_key(text: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]


class Terms(WordHasher):
    """Terms of a text column with the keys of their prefixes."""

    def __init__(self):
        super().__init__(lower=True, space=term_gaps())

    def totals(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        return total

    def keys(self, total: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int, lang: np.ndarray) -> np.ndarray:
        """Key of the first ``limit`` bytes; the lowest bit tells that the term is complete."""
        n = np.minimum(lengths, limit)
        h = (total[starts + n] - total[starts]) * self.inverse[starts]
        h = mixed(mixed(h + n.astype(np.uint64)) ^ lang)
        return (h & ~np.uint64(1)) | (lengths <= limit).astype(np.uint64)


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - MAP_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal neighbours."""
    change = np.ones(len(columns[0]), bool)
    if len(change):
        change[1:] = False
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _pieces(batch: pa.RecordBatch, terms: Terms) -> Iterator[tuple]:
    """(lower-cased bytes, running hash, starts, lengths, rows) for pieces of a batch, by groups of whole rows."""
    data, offsets = column_bytes(batch.column("text"))
    for i, j in row_groups(offsets, GROUP_BYTES):
        parts = []
        for a, b, edges in terms.pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            if a == b:
                continue
            piece = terms.lower[data[offsets[i] + a : offsets[i] + b]]
            starts, ends = terms.spans(piece, edges)
            rows = i + np.searchsorted(offsets[i : j + 1] - offsets[i], starts + a, "right") - 1
            parts.append((piece, terms.totals(piece), starts, ends - starts, rows))
        yield parts


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    codes = batch.column("lang").dictionary_encode()
    keys = np.array([group_key(x) for x in codes.dictionary.to_pylist()] or [0], np.uint64)
    return keys[codes.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else keys[:0]


def _count_prefixes(before: int, length: int, bits: bytes | None):
    """Task function: (key, docs) of the prefixes of ``length`` bytes, summed over a few MB of text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known = Terms(), np.frombuffer(zlib.decompress(bits), np.uint8) if bits is not None else None
        for batch in batches:
            lang = _languages(batch)
            for parts in _pieces(batch, terms):
                keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for _, total, starts, lengths, row in parts:
                    if known is not None:
                        long = lengths > before
                        starts, lengths, row = starts[long], lengths[long], row[long]
                        frequent = in_map(known, terms.keys(total, starts, lengths, before, lang[row]))
                        starts, lengths, row = starts[frequent], lengths[frequent], row[frequent]
                    keys.append(terms.keys(total, starts, lengths, length, lang[row]))
                    docs.append(row)
                key, row = np.concatenate(keys), np.concatenate(docs)
                order = np.argsort(key, kind="stable")  # rows rise, so they also rise within a key
                key, row = key[order], row[order]
                key = key[_runs(key, row)]
                first = _runs(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(np.diff(np.append(first, len(key))))], names=["key", "docs"]
                )

    return rows


def _term_words(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, j: int) -> np.ndarray:
    """Bytes 8 j to 8 j + 7 of every term as a number; bytes behind the term count as 0."""
    rest = np.minimum(lengths - 8 * j, 8).astype(np.uint64)
    mask = np.uint64(2**64 - 1) >> (np.uint64(8) * (np.uint64(8) - rest))
    return view[starts + 8 * j] & mask


def _count_terms(levels: list[int], bits: list[bytes]):
    """Task function: documents and occurrences of the terms that may be frequent, by lang and source."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, maps = Terms(), [np.frombuffer(zlib.decompress(b), np.uint8) for b in bits]
        for batch in batches:
            lang = _languages(batch)
            group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            pairs = {}
            code = np.array([pairs.setdefault((g["lang"], g["source"]), len(pairs)) for g in group.to_pylist()], np.int64)
            names = list(pairs)
            for parts in _pieces(batch, terms):
                at, found = 0, [(np.zeros(0, np.int64),) * 3]
                for piece, total, starts, lengths, row in parts:
                    keep = np.zeros(len(starts), bool)
                    for low, high, known in zip([0, *levels], levels, maps, strict=False):
                        here = np.flatnonzero((lengths > low) & (lengths <= high))
                        keep[here] = in_map(known, terms.keys(total, starts[here], lengths[here], high, lang[row[here]]))
                    found.append((starts[keep] + at, lengths[keep], row[keep]))
                    at += len(piece)
                data = np.concatenate([np.zeros(0, np.uint8), *[p[0] for p in parts]])
                starts, lengths, row = (np.concatenate(c) for c in zip(*found, strict=True))
                yield _exact_counts(data, starts, lengths, row, code, names)

    return rows


def _exact_counts(data, starts, lengths, row, code, names) -> pa.RecordBatch:
    """Counts of equal terms by group.  Terms are told apart by their bytes, eight at a time."""
    key, here, top = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    view = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    for j in range((int(lengths.max(initial=0)) + 7) // 8):
        here = here[lengths[here] > 8 * j]
        word = _term_words(view, starts[here], lengths[here], j)
        # numbers of the distinct (number so far, word); shorter terms keep theirs, apart from these
        order = np.lexsort((word, key[here]))
        fresh = np.zeros(len(here), np.int64)
        fresh[_runs(key[here][order], word[order])] = 1
        number = np.empty(len(here), np.int64)
        number[order] = np.cumsum(fresh)
        key[here] = number + top
        top += int(fresh.sum())
    order = np.lexsort((row, code[row], key))
    key, at, row = key[order], starts[order], row[order]
    runs = _runs(key, row)
    times = np.diff(np.append(runs, len(key)))
    key, at, group, n = key[runs], at[runs], code[row[runs]], lengths[order][runs]
    first = _runs(key, group)
    ends = np.append(first, len(key))
    occurrences = np.add.reduceat(times, first) if len(first) else times
    raw = data.tobytes()
    text = [raw[a : a + k].decode("utf-8", "replace") for a, k in zip(at[first].tolist(), n[first].tolist(), strict=True)]
    of = [names[g] for g in group[first].tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([g[0] for g in of], pa.string()), pa.array([g[1] for g in of], pa.string()), pa.array(text, pa.string()),
         pa.array(np.diff(ends)), pa.array(occurrences)],
        names=["lang", "source", "term", "docs", "n"],
    )


def _bit_map(keys: DataFrame) -> bytes:
    """The keys as a bit map: at most 2**MAP_BITS bits reach the driver, whatever their number."""
    at = F.shiftrightunsigned("key", 64 - MAP_BITS)
    parts = keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.expr(f"bitmap_construct_agg(shiftrightunsigned(key, {64 - MAP_BITS}) & 32767)").alias("bits"))
    out = np.zeros(2**MAP_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return zlib.compress(out.tobytes(), 1)


def frequent_terms(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n): the occurrences of every term that ``min_docs`` documents of its lang hold.

    Reads ``text``, ``lang`` and ``source``.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    levels, maps, before, bits = [], [], 0, None
    while True:
        length = 2 * before or FIRST
        counts = read.select("lang", "text").mapInArrow(_count_prefixes(before, length, bits), "key bigint, docs bigint")
        found = cut(counts.groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("key"))
        levels.append(length)
        maps.append(_bit_map(found.where("key & 1 = 1")))
        open_ = found.where("key & 1 = 0")
        if open_.isEmpty():
            break
        before, bits = length, _bit_map(open_)
    rows = read.mapInArrow(_count_terms(levels, maps), "lang string, source string, term string, docs bigint, n bigint")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = cut(counts)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= min_docs).select("lang", "term")
    return counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact at any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH)
    return (F.lit(1) + F.call_function("div", top, F.nullif(wide(total + SMOOTH * terms), F.lit(0).cast("decimal(20,0)")))).cast("long")


def _pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of |p - p'| over the terms of a block, for the sources of one or two tiles."""
    marks = frame[frame["term"].isna()]
    names, rest = marks["source"].to_numpy(object), marks["rest"].to_numpy(np.int64)
    tile = marks["tile"].to_numpy()
    order = np.argsort(names)
    names, rest, tile = names[order], rest[order], tile[order]
    rows = frame[frame["term"].notna()]
    term, terms = pd.factorize(rows["term"])
    source = np.searchsorted(names, rows["source"].to_numpy(object)) if len(rows) else np.zeros(0, np.int64)
    value = rows["p"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    sums = np.zeros((len(names), len(names)), np.int64)
    by_term = np.argsort(term, kind="stable")
    term, source, value = term[by_term], source[by_term], value[by_term]
    step = max(1, 1_000_000 // max(len(names), 1))
    for a in range(0, len(terms), step):
        i, j = np.searchsorted(term, [a, a + step])
        dense = np.repeat(rest[:, None], min(step, len(terms) - a), axis=1)
        dense[source[i:j], term[i:j] - a] = value[i:j]
        for k in range(len(names)):
            sums[k] += np.abs(dense - dense[k]).sum(axis=1)
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    x, y = np.triu_indices(len(names), 1)
    # inside one tile all pairs, of two tiles the pairs across
    mine = (tile[x] != tile[y]) | (low == high)
    x, y = x[mine], y[mine]
    return pd.DataFrame({
        "lang": frame["lang"].iloc[0], "a": names[x], "b": names[y], "part": sums[x, y], "terms": np.full(len(x), len(terms), np.int64),
    })


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Distances between the sources of each language, and the terms that stand out in a source.

    Returns lang, source, part, item, value and rank.  ``pair``: item is another source of the
    language, value the sum over all frequent terms of the difference of their smoothed
    shares in parts of 10**9.  ``term``: item is a term whose share in the source is above that in
    the language, value the difference; the first ``top``.
    """
    counts = cut(frequent_terms(docs, min_docs=min_docs))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    by_lang = cut(by_lang)
    sizes = by_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = found.join(totals, ["lang", "source"], "left").join(small_side(cut(sizes)), "lang", "left").select(
        "lang", "source", zero("total"), zero("rows"), zero("terms"), zero("total_lang")
    )
    groups = cut(groups.withColumn("rest", F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))))
    shape = cut(groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.sum("rows") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"),
        F.ceil(F.count("*") / TILE).cast("int").alias("tiles"),
    ))
    facts = small_side(cut(groups.join(small_side(shape), "lang")))
    shares = counts.join(facts, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    ahead = shares.join(by_lang, ["lang", "term"]).withColumn("q", _share(F.col("n_lang"), F.col("total_lang"), F.col("terms")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ahead.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    # every count meets every tile of its language; a mark a block names the sources that lack its terms
    entries = shares.select("lang", "source", "term", "p", "rest", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), tile, "tiles")
    marks = groups.join(small_side(shape), "lang").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "rest",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), tile, "tiles",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spread = entries.unionByName(marks).select("lang", "block", "source", "term", "p", "rest", "tile", other).select(
        "lang", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "source", "term", "p", "rest", "tile"
    )
    sums = spread.groupBy("lang", "block", "low", "high").applyInPandas(_pair_sums, "lang string, a string, b string, part bigint, terms bigint")
    sums = cut(sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("terms").alias("met")))
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("rest").alias(f"rest_{name}"), F.col("terms").alias(f"terms_{name}"))
    pairs = sums.join(small_side(side("a")), ["lang", "a"]).join(small_side(side("b")), ["lang", "b"])
    pairs = pairs.withColumn("value", F.col("part") + (F.col("terms_a") - F.col("met")) * F.abs(F.col("rest_a") - F.col("rest_b")))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
f AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM f GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
c AS (SELECT lang, source, term, coalesce(o.c, 0) AS c FROM g JOIN f USING (lang) LEFT JOIN o USING (lang, source, term)),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.c, 1 + ({SCALE}::HUGEINT * (c.c + {SMOOTH})) // (s.n + {SMOOTH} * v.v) AS p,
    1 + ({SCALE}::HUGEINT * (f.c + {SMOOTH})) // (v.n + {SMOOTH} * v.v) AS q
  FROM c JOIN s USING (lang, source) JOIN v USING (lang) JOIN f USING (lang, term)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM b)
WHERE part = 'pair' OR rank <= {TOP}
"""


@query("op11_divergence", OP11_SQL)
def op11_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
