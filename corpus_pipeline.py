"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of the
documents; the last returns the shard and slot of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.decontaminate import decontaminated
from fleetlens.llm.jaccard import one_of_each
from fleetlens.llm.mixing import mixed_documents
from fleetlens.llm.registry import table
from fleetlens.llm.sharding import shard_documents
from fleetlens.llm.toxicity import THRESHOLD, fit, scorer
from fleetlens.session import stage_path

# the models of a stage and the order of the hashes are no SQL
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score reaches the threshold.

    The classifier learns from the labelled rows of ``documents`` as they come from the
    tables.  Rows are scored where they lie, each row for itself, so repeated ids and
    extra columns do no harm.
    """
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    packed = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    scored = packed.mapInArrow(
        scorer(*model), f"row {packed.schema['row'].dataType.simpleString()}, score double"
    )
    return scored.where(F.col("score") < THRESHOLD).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-equal texts (5 words, similarity 0.8)."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target weight; repeated documents are repeated rows."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
