"""Running totals inside groups of any size, without a one-task window.

The rows of a group are cut into ranges of a uniform hash key, so that a range
holds about ``RANGE_ROWS`` rows however large the group is.  The ranges are summed
with map-side combine, their totals are accumulated in two levels, and only then
does a window run inside each range.  The largest window over totals has one row
per ``RANGE_ROWS * FAN`` rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 512
FAN = 1024
KEY_BITS = 52


def hash_key(text: Column) -> Column:
    """A uniform integer of 52 bits from the first 13 hex digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_unit(text: Column) -> Column:
    """The same draw as a number in (0, 1]."""
    return (hash_key(text) + 1) / F.lit(float(2**KEY_BITS))


def ranges(rows: Column) -> Column:
    """How many hash ranges a group of ``rows`` rows is cut into."""
    return F.greatest(F.ceil(rows / RANGE_ROWS), F.lit(1)).cast("long")


def range_of(key: Column, n_ranges: Column) -> Column:
    """The range of a key; it never falls when the key rises."""
    return F.floor(key / F.lit(float(2**KEY_BITS)) * n_ranges).cast("long")


def running_before(
    rows: DataFrame, group: list[str], rng: str, order: list[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group.

    Earlier means a smaller range ``rng``, then a smaller ``order``.  ``rows`` is read
    twice and should be materialised.  Group columns must not be null.
    """
    sums = rows.groupBy(*group, rng).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_top", F.floor(F.col(rng) / FAN).cast("long"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(*group, "_top").agg(F.sum("_sum").alias("_tsum"))
    tops = tops.select(
        *group, "_top",
        F.coalesce(F.sum("_tsum").over(earlier(*group).orderBy("_top")), F.lit(0)).alias("_above"),
    )
    offsets = sums.join(tops, [*group, "_top"]).select(
        *group, rng,
        (F.col("_above") + F.coalesce(
            F.sum("_sum").over(earlier(*group, "_top").orderBy(rng)), F.lit(0)
        )).alias("_offset"),
    )
    inside = F.coalesce(F.sum(value).over(earlier(*group, rng).orderBy(*order)), F.lit(0))
    return (
        rows.join(offsets, [*group, rng])
        .withColumn(out, (F.col("_offset") + inside).cast("long"))
        .drop("_offset")
    )
