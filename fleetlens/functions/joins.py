"""Broadcast behind a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import cut, cut_measured

BROADCAST_BYTES = 64 * 1024 * 1024


def _bytes(df: DataFrame) -> Column:
    """Rough in-memory size: lengths of text, binary and nested values, 16 bytes for the rest."""
    row = F.lit(0).cast("bigint")
    for field in df.schema:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(column), F.lit(0)) + 24
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            row = row + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 24
        else:
            row = row + 16
    return F.coalesce(F.sum(row), F.lit(0))


def measured_bytes(df: DataFrame) -> int:
    """The rough in-memory size of ``df``."""
    return df.agg(_bytes(df)).first()[0]


def small_side(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast when its measured size allows it.

    Beyond the limit the side is returned as it is: the join then shuffles, and
    AQE splits the partitions of a hot key.  ``df`` should be materialised, since
    measuring reads it.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def reduced_side(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A side that an aggregate has cut down to about one row per database.

    The optimizer cannot know how few rows are left and would shuffle the big
    other side.  The rows are materialised once, measured, and broadcast if small.
    """
    return small_side(cut(df), limit=limit)


def cut_side(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``small_side`` of ``df`` as it is materialised here; it is measured while it is written."""
    found, size = cut_measured(df, _bytes(df))
    return F.broadcast(found) if size <= limit else found
