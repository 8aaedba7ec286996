"""Ordered work inside a key that survives a hot key.

A window over (key) alone puts a whole key into one task.  The helpers here cut
every key into time blocks: the window runs inside (key, block), and one carry
row per block, built with a partial aggregate, brings the state over the block
border.  Work per task then depends on the busiest block and not on the busiest
key; the carry table has one row per (key, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def _carry(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last non-null value of all earlier blocks, per (key, block)."""
    per_block = df.groupBy(*keys, BLOCK).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys,
        BLOCK,
        F.last("_last", ignorenulls=True).over(earlier).alias("_carry"),
    )


def latest_so_far(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    *,
    ties: list[str] | None = None,
    strict: bool = False,
    block: str = "MONTH",
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before the row.

    With ``strict`` the row itself is left out, which is the classic LAG that
    skips NULLs.  ``order`` must be a timestamp; ``ties`` settles equal times.  Keys
    must not be NULL.
    """
    rows = df.withColumn(BLOCK, F.date_trunc(block, F.col(order)))
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    )
    # the tie columns decide the last row of a block too
    ranked = F.struct(F.col(order), *[F.col(t) for t in ties or []])
    carry = _carry(rows.withColumn("_rank", ranked), keys, "_rank", value)
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    # the join key is the window's partition key, so the rows are shuffled once
    joined = here.join(carry, [*keys, BLOCK], "left")
    return joined.select(*df.columns, F.coalesce("_here", "_carry").alias(out))


def asof_latest(
    history: DataFrame,
    requests: DataFrame,
    keys: list[str],
    history_time: str,
    request_time: str,
    payload: list[str],
    *,
    ties: list[str] | None = None,
    block: str = "MONTH",
) -> DataFrame:
    """For each request the latest history row of its key at or before its time.

    History and requests are unioned and read once in time order, so no pair of
    (request, earlier row) is ever formed.  Adds a struct ``asof`` (NULL when no
    row qualifies) to the requests.
    """
    event = F.struct(F.col(history_time).alias("at"), *[F.col(p) for p in payload])
    # typed, so numbers and text of any length keep their own order
    tie = F.struct(*[F.col(t) for t in ties]) if ties else F.lit("")
    past = history.select(
        *keys, F.col(history_time).alias("_at"), F.lit(0).alias("_kind"),
        tie.alias("_tie"), event.alias("_event"),
        F.lit(None).cast(requests.schema).alias("_request"),
    )
    asked = requests.select(
        *keys, F.col(request_time).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(past.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(past.schema["_event"].dataType).alias("_event"),
        F.struct(*[F.col(c) for c in requests.columns]).alias("_request"),
    )
    both = past.unionByName(asked)
    filled = latest_so_far(
        both, keys, "_at", "_event", "asof", ties=["_kind", "_tie"], block=block
    )
    return filled.where("_kind = 1").select("_request.*", "asof")




def number_rows(df: DataFrame, order: list[str], out: str, *, start: int = 1) -> DataFrame:
    """Number rows 1, 2, 3, ... in a total order without a one-task window.

    Range partitioning sorts the data across tasks; a window numbers inside each
    partition and the partition offsets (one row per partition) are added.  The
    partitioned rows are materialised first, because the sampled borders of a
    range partitioning must not differ between the two reads.
    """
    from fleetlens.session import cut

    ranged = cut(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id())
    )
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, not by the data
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.row_number().over(inside) + F.col("_offset") + F.lit(start - 1)).cast("bigint"))
        .select(*df.columns, out)
    )
