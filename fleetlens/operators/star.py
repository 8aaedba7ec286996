"""Star schema from a flat table: dimensions, fact, view and increments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.joins import BROADCAST_BYTES
from fleetlens.functions.ordered import number_rows
from fleetlens.session import cut


def dimension_columns(df: DataFrame, *, exclude: str = "") -> list[str]:
    """String columns of the schema, without the comma-separated exclusions."""
    skip = set(exclude.split(","))
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def key_name(column: str) -> str:
    """Key column of a dimension: the name without underscores, and Key."""
    return column.replace("_", "") + "Key"


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, name) of every row and column, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("name")) for c in columns])
    return df.select(F.inline(pairs))


def column_cardinality(df: DataFrame, *, exclude: str = "") -> DataFrame:
    """Rows per value of every string column, most frequent first."""
    counts = _pairs(df, dimension_columns(df, exclude=exclude)).groupBy("dimension", "name").agg(F.count("*").alias("row_count"))
    return counts.orderBy("dimension", F.desc("row_count"), "name")


def dimension_summary(df: DataFrame, *, exclude: str = "") -> DataFrame:
    """Candidate dimensions with their key name and number of distinct names."""
    columns = dimension_columns(df, exclude=exclude)
    keys = F.create_map(*[F.lit(x) for c in columns for x in (c, key_name(c))])
    distinct = _pairs(df, columns).distinct()
    return distinct.groupBy("dimension").agg(F.count("name").alias("distinct_names")).select(
        "dimension", F.element_at(keys, F.col("dimension")).alias("key_name"), "distinct_names"
    )


def _number(names: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Keys 1, 2, 3, ... per dimension in name order, above ``start`` if given.

    All dimensions are numbered in one global order, in 64 bits, and shifted to their own
    start; only then must a dimension fit its INT keys.  The shift is one row per
    dimension.
    """
    numbered = number_rows(names, ["dimension", "name"], "_n")
    shift = numbered.groupBy("dimension").agg((F.min("_n") - 1).alias("_shift"))
    if start is not None:
        shift = shift.join(start, "dimension", "left").select(
            "dimension", (F.col("_shift") - F.coalesce("_top", F.lit(0))).alias("_shift")
        )
    # one row per string column of the table
    return numbered.join(F.broadcast(shift), "dimension").select(
        "dimension", (F.col("_n") - F.col("_shift")).cast("int").alias("key"), "name"
    )


def build_dimensions(df: DataFrame, *, exclude: str = "") -> DataFrame:
    """All dimensions in one table (dimension, key, name).

    Names are unique and not NULL; keys follow the name order, so they do not
    depend on how the table is partitioned.
    """
    columns = dimension_columns(df, exclude=exclude)
    return _number(_pairs(df, columns).where(F.col("name").isNotNull()).distinct())


def dimension(dimensions: DataFrame, column: str) -> DataFrame:
    """One dimension as its own table."""
    return dimensions.where(F.col("dimension") == column).select(F.col("key").alias(key_name(column)), F.col("name").alias("Name"))


def _sides(dimensions: DataFrame, columns: list[str], limit: int) -> dict[str, DataFrame]:
    """(key, name) of each dimension, marked for broadcast where its size allows it.

    All sizes come out of one aggregate, one row per string column.
    """
    size = F.sum(F.coalesce(F.octet_length("name"), F.lit(0)) + 40)
    sizes = {r.dimension: r.bytes for r in dimensions.groupBy("dimension").agg(size.alias("bytes")).collect()}
    sides = {c: dimensions.where(F.col("dimension") == c).select("key", "name") for c in columns}
    return {c: F.broadcast(side) if sizes.get(c, 0) <= limit else side for c, side in sides.items()}


def build_fact(df: DataFrame, dimensions: DataFrame, *, exclude: str = "", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table with each dimension column replaced by its nullable key."""
    out = df
    columns = dimension_columns(df, exclude=exclude)
    for c, side in _sides(dimensions, columns, broadcast_bytes).items():
        out = out.join(side.select(F.col("name").alias(c), F.col("key").alias(key_name(c))), c, "left")
    return out.select(*[key_name(c) if c in columns else c for c in df.columns])


def star_view(fact: DataFrame, dimensions: DataFrame, columns: list[str], *, exclude: str = "", names: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The fact joined back to its dimensions, with the columns of the source.

    ``columns`` is the column order of the source; ``names`` its dimension columns,
    by default those whose key the fact holds.
    """
    dims = names if names is not None else [c for c in columns if c not in fact.columns and key_name(c) in fact.columns]
    out = fact
    for c, side in _sides(dimensions, dims, broadcast_bytes).items():
        out = out.join(side.select(F.col("key").alias(key_name(c)), F.col("name").alias(c)), key_name(c), "left")
    return out.select(*columns)


@dataclass
class Star:
    dimensions: DataFrame
    fact: DataFrame
    columns: list[str]

    def view(self) -> DataFrame:
        return star_view(self.fact, self.dimensions, self.columns)


def star_schema(df: DataFrame, *, exclude: str = "") -> Star:
    """Dimensions and fact of a flat table."""
    dims = cut(build_dimensions(df, exclude=exclude))
    return Star(dims, build_fact(df, dims, exclude=exclude), df.columns)


def incremental_dim_load(star: Star, rows: DataFrame, *, exclude: str = "", identity: tuple[str, ...] = ()) -> Star:
    """Load more rows: new names get keys above the present ones, then the fact grows.

    Identity columns are left to the target and come out NULL.
    """
    columns = dimension_columns(rows, exclude=exclude)
    fresh = (
        _pairs(rows, columns).where(F.col("name").isNotNull()).distinct()
        .join(star.dimensions.select("dimension", "name"), ["dimension", "name"], "left_anti")
    )
    top = star.dimensions.groupBy("dimension").agg(F.max("key").alias("_top"))
    dims = cut(star.dimensions.unionByName(_number(fresh, top)))
    added = build_fact(rows, dims, exclude=exclude)
    for c in identity:
        added = added.withColumn(c, F.lit(None).cast(added.schema[c].dataType))
    return Star(dims, star.fact.unionByName(added), star.columns)
