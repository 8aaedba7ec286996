"""Mixing of sources to target weights.

Every document gets a hash-random key.  Inside each source the documents are
range-sorted by that key, running word totals are computed over the ranges, and
the source is cut where its budget is spent; a budget above the source's size
starts another epoch.  Everything is DataFrame code, and the budget is met to the
word: the document on the cut gives only its first words.

Defined cases: a null or empty text has size 0 and is never taken; a null source is
a source of its own, last in order; the key is drawn from id and whole text, so rows
without an id or with a repeated one spread like others; repeated rows count as often
as they occur (equal rows share a key and may swap their parts); a very long text
counts whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.joins import small_side
from fleetlens.llm.registry import query, table
from fleetlens.llm.running import hash_key, range_of, ranges, running_before
from fleetlens.session import cut

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_budgets(sources: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Add ``target`` to one row per source with ``weight`` and ``source_size``.

    The total size is shared by weight; no target exceeds ``cap`` sizes, and what is
    above goes to the others by weight.  Ordered by size per weight, the capped
    sources come first; the common share per weight rises up to the last of them and
    falls from there on, so it is the largest that its own source can bear.  The windows see one row per source.
    """
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_full") / F.col("weight"), "_null", "_source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = sources.withColumn("_full", F.col("source_size") * cap).withColumns({
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_full").over(before), F.lit(0)),
        "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    share = F.col("_left").cast("double") / F.col("_weights")
    bears = share * F.col("weight") <= F.col("_full")
    rows = rows.withColumn("_share", F.max(F.when(bears, share)).over(everything))
    target = F.least(F.col("_full").cast("double"), F.col("_share") * F.col("weight"))
    return rows.withColumn("target", target).drop("_full", "_left", "_weights", "_share")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Reads ``doc_id``, ``text``, ``source``.  Sources in code point order (null last) get
    ``weights`` in turn.  Returns doc_id, source, size, source_size, weight, target,
    epochs (whole repeats of the source), part (words of the last, partial
    epoch), taken = epochs * size + part and text_key (a hash of the text).
    """
    identity = F.concat_ws(
        ":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))
    )
    rows = cut(docs.select(
        "doc_id", "source",
        F.col("source").isNull().alias("_null"),
        F.coalesce("source", F.lit("")).alias("_source"),
        word_count(F.col("text")).alias("size"),
        hash_key(identity).alias("_key"),
        F.xxhash64("text").alias("text_key"),
    ))
    rank = F.row_number().over(Window.orderBy("_null", "_source")) - 1
    turn = F.array(*[F.lit(w) for w in weights])
    sources = rows.groupBy("_null", "_source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_rows")
    )
    sources = sources.withColumn("weight", F.element_at(turn, (rank % len(weights) + 1).cast("int")))
    sources = source_budgets(sources, cap=cap)
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("_rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    # one row per source: broadcast behind its measured size, so no source fills a task
    placed = rows.join(small_side(cut(sources)), ["_null", "_source"]).withColumn(
        "_range", range_of(F.col("_key"), ranges(F.col("_rows")))
    )
    run = running_before(placed, ["_null", "_source"], "_range", ["_key", "doc_id", "size", "text_key"], "size", "_before")
    part = F.greatest(F.least(F.col("size"), F.col("_rest") - F.col("_before")), F.lit(0))
    return run.withColumn("part", part.cast("long")).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "epochs", "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "text_key",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them.

    A document stays whole here: the one on the cut comes once more if at least half
    of it is within the budget, so a source misses its budget by half a document at
    most.  Documents without words take no budget and stay once.  Columns as given.
    """
    taken = mix(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("text_key").alias("_text"),
        F.when(F.col("size") == 0, 1).otherwise(
            F.col("epochs") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
        ).alias("_copies"),
    )
    # rows that agree in id, source and text are interchangeable: their copies are pooled
    pools = cut(taken.groupBy("_id", "_src", "_text").agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_same")))
    pools = pools.where("_copies > 0")
    columns = [docs[c] for c in docs.columns]
    text = F.xxhash64(docs["text"])

    def drawn(pools: DataFrame, *more: str) -> DataFrame:
        pools = small_side(pools)
        same = docs["doc_id"].eqNullSafe(pools["_id"]) & docs["source"].eqNullSafe(pools["_src"]) & (text == pools["_text"])
        return docs.join(pools, same).select(F.struct(*columns).alias("_row"), *more)

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each").cast("int")))).select("_row.*")

    out = repeated(drawn(pools.where("_same = 1").withColumn("_each", F.col("_copies")), "_each"))
    shared = pools.where("_same > 1")
    if shared.isEmpty():
        return out
    # equal rows get the whole part each, and the first ones of a pool, counted over partitions, one more
    shared = shared.withColumn("_pool", F.xxhash64(F.col("_id").isNull(), "_id", F.col("_src").isNull(), "_src", "_text"))
    rows = cut(drawn(shared, "_pool", "_copies", "_same").withColumns({
        "_place": F.spark_partition_id(), "_tie": F.monotonically_increasing_id(), "_one": F.lit(1),
    }))
    rows = running_before(rows, ["_pool"], "_place", ["_tie"], "_one", "_number")
    more = F.when(F.col("_number") < F.col("_copies") % F.col("_same"), 1).otherwise(0)
    rows = rows.withColumn("_each", F.floor(F.col("_copies") / F.col("_same")) + more).where("_each > 0")
    return out.unionByName(repeated(rows))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::INT + 1] AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share
  FROM r WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, weight * (SELECT max(share) FROM f WHERE share * weight <= 3 * source_size)) AS target FROM f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
x AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM x
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
