"""Connected components of a graph given as links, by labels that fall and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut, cut_measured


def components(links: DataFrame, *, tasks: int) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label, so long chains shrink quickly.  Minima are partial aggregates,
    so a node with very many links fills no task; nothing is gathered.  What a round
    writes comes from ``tasks`` tasks at most.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct().coalesce(tasks))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")).coalesce(tasks))
    while True:
        offers = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "comp")
        own = labels.select("node", "comp", F.col("comp").alias("_old"))
        lowest = own.union(offers.withColumn("_old", F.lit(None).cast("bigint")).coalesce(tasks)).groupBy("node").agg(
            F.min("comp").alias("low"), F.max("_old").alias("_old")
        ).coalesce(tasks)
        of = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        jumped = lowest.join(of, lowest["low"] == of["_n"], "left").select(
            "node", F.least(F.col("low"), F.coalesce("_c", "low")).alias("comp"), "_old"
        )
        after, fell = cut_measured(jumped.coalesce(tasks), F.count_if(F.col("comp") < F.col("_old")))
        labels = after.select("node", "comp")
        if not fell:
            return labels
