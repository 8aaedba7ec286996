from pyspark.sql import functions as F

from fleetlens.operators import star as s
from fleetlens.session import cut

SCHEMA = "id bigint, city string, city_name string, note string, amount double"
ROWS = [(1, "x", "x1", "n1", 1.0), (2, None, "x2", "n2", 2.0), (3, "y", None, None, 3.0), (4, "x", "x1", "n4", 4.0)]


def test_round_trip_with_prefix_names_and_nulls(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    star = s.star_schema(df, exclude="note")
    assert star.fact.columns == ["id", "cityKey", "citynameKey", "note", "amount"]
    assert rows(star.view()) == rows(df)
    assert star.view().columns == df.columns


def test_keys_do_not_depend_on_partitioning(spark, rows):
    df = spark.createDataFrame([(i, f"n{i * 13 % 97:02d}", "c", None, 0.0) for i in range(300)], SCHEMA)
    first = rows(s.build_dimensions(df.repartition(1)))
    assert rows(s.build_dimensions(df.repartition(7, "amount", "id"))) == first
    assert [k for d, k, _ in sorted(first) if d == "city"] == list(range(1, 98))


def test_join_without_broadcast_gives_the_same_fact(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    dims = cut(s.build_dimensions(df))
    assert rows(s.build_fact(df, dims, broadcast_bytes=0)) == rows(s.build_fact(df, dims))
    plan = s.build_fact(df, dims, broadcast_bytes=0)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()


def test_increment_keeps_old_keys_and_adds_above(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    star = s.star_schema(df, exclude="note")
    more = spark.createDataFrame([(5, "a", "x1", "n5", 5.0), (6, None, None, "n6", 6.0), (7, "x", "b", "n7", 7.0)], SCHEMA)
    grown = s.incremental_dim_load(star, more, exclude="note")
    old = {(d, n): k for d, k, n in rows(star.dimensions)}
    new = {(d, n): k for d, k, n in rows(grown.dimensions)}
    assert {x: new[x] for x in old} == old
    assert new["city", "a"] == 3 and new["city_name", "b"] == 3
    assert rows(grown.view()) == rows(df.unionByName(more))
    blank = s.incremental_dim_load(star, more, exclude="note", identity=("id",))
    assert blank.fact.where(F.col("id").isNull()).count() == 3


def test_metadata(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert s.dimension_columns(df, exclude="note,city") == ["city_name"]
    assert s.key_name("city_name") == "citynameKey"
    assert ("city", "x", 2) in rows(s.column_cardinality(df))
