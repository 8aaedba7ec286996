"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id is held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(True))


def below_share(h: Column, wanted: int, rows: int) -> Column:
    """Rows whose 64-bit hash lies in the lowest part that holds about 1.5 times what is wanted.

    What is then sorted has a bounded size, whatever the number of rows and tasks.
    """
    share = min(1.0, 1.5 * wanted / max(rows, 1) + 1e-9)
    return F.lit(True) if share == 1.0 else h <= F.lit(int(-(2**63) + share * (2**64 - 1)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, rows_per_class: int, max_bytes: int, folds: int, fold: int
) -> DataFrame:
    """At most ``rows_per_class`` texts of each class, first in the order of a hash.

    Only rows outside the held-out fold, with a text of at most ``max_bytes``.  Ids that
    carry both labels count as the higher one.  The ids are picked from the labels
    alone, so the texts are read once, against a broadcast of a bounded size.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).alias("_y"))
        .withColumn("_h", F.xxhash64("doc_id", F.lit(label)))
    )
    counts = {r["_y"]: r["count"] for r in ids.groupBy("_y").count().collect()}  # two rows
    picked = None
    for y in (0, 1):
        few = ids.where((F.col("_y") == y) & below_share(F.col("_h"), rows_per_class, counts.get(y, 0)))
        one = few.orderBy("_h", "doc_id").limit(rows_per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # a repeated id gives one text
    return (
        texts.join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.first("_y").alias("y"), F.min("text").alias("text"), F.first("_h").alias("_h"))
        .orderBy("_h", "doc_id")
        .limit(2 * rows_per_class)
    )
