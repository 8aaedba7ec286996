import random

import pytest
from pyspark.sql import functions as F

from fleetlens import session
from fleetlens.llm.components import components


def lowest_reachable(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return sorted((x, find(x)) for x in list(parent))


@pytest.mark.parametrize(
    "links",
    [
        [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (101, 100)],  # a chain, and links both ways and twice
        [(7, i) for i in range(8, 40)] + [(3, 39), (50, 50)],  # a star with a tail, and a link to itself
        [(random.Random(i).randrange(60), random.Random(-i - 9).randrange(60)) for i in range(45)],
        [],
    ],
)
def test_components_are_the_smallest_reachable_nodes(spark, links):
    found = components(spark.createDataFrame(links, "a bigint, b bigint"), tasks=3)
    assert found.columns == ["node", "comp"]
    assert sorted(tuple(r) for r in found.collect()) == lowest_reachable(links)


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimates_do_not_grow_from_round_to_round(spark):
    found = session.cut(spark.range(100).withColumn("x", F.col("id") % 7))
    small = estimate(found)
    assert small <= 100 * 32  # a known size stays
    for _ in range(10):
        again = found.select("id", F.col("x").alias("y"))
        found = session.cut(found.join(again, "id").groupBy("id").agg(F.max("y").alias("x")))
        assert estimate(found) <= 2**63 - 1
    assert sorted(map(tuple, found.collect())) == [(i, i % 7) for i in range(100)]
    # joined with itself
    assert found.alias("l").join(found.alias("r"), F.col("l.id") == F.col("r.x")).count() == 100
