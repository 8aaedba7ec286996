"""Greedy time throttle that stays exact and parallel on a hot key.

A key responds at its first instant, then at the first instant that is at least
``delay`` later, and so on; every response restarts the clock, so the answer at
one time depends on all earlier times of the key.  The work is still split:

1. the caller collapses equal instants of a key to one row (partial aggregate) and
   materialises them, because they are read twice;
2. each (key, time block) computes, on its own, how it maps the time from which
   the key is open again to its last response - a step function that only has
   steps for entries inside the first ``delay`` of the block;
3. per key these small functions are chained over the blocks;
4. each block, now knowing when it is entered, emits its responses.

Keys are packed by hash, so that many small keys share one call; a group is one
time block of one pack.  Only step 3 looks at whole keys, and it sees step
functions instead of events.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_DELAYS = 128  # block length in delays
PACK_ROWS = 100_000  # rows that are worth a pack of their own


def last_responses(instants: np.ndarray, delay: int) -> np.ndarray:
    """Index of the last response when the chain starts at each instant."""
    if len(instants) == 1:
        return np.zeros(1, dtype=np.int64)
    following = np.searchsorted(instants, instants + delay)
    last = np.arange(len(instants))
    for i in range(len(instants) - 1, -1, -1):
        if following[i] < len(instants):
            last[i] = last[following[i]]
    return last


def respond(instants: np.ndarray, delay: int, open_from: int) -> np.ndarray:
    """Instants that respond when the key opens at ``open_from``."""
    out = []
    i = int(np.searchsorted(instants, open_from))
    while i < len(instants):
        out.append(instants[i])
        i = int(np.searchsorted(instants, instants[i] + delay))
    return np.array(out, dtype=np.int64)


def _steps(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Step function of one block of a key: up to ``entry`` the last response is ``exit``."""
    instants = np.sort(rows["_us"])
    delay, block = int(rows["_delay"][0]), int(rows["_block"][0])
    last = instants[last_responses(instants, delay)]
    # an entry lies before the block's start + delay, or is the first instant after
    # it; in the first block of a key it is the very first instant
    reach = min(int(np.searchsorted(instants, block * delay * BLOCK_DELAYS + delay)) + 1, len(instants))
    entry, end = instants[:reach], last[:reach]
    edge = np.append(end[1:] != end[:-1], True)
    entry, end = entry[edge], end[edge]
    return np.full(len(entry), block), np.full(len(entry), delay), entry, end


def _chain(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Time from which each block of one key is open."""
    order = np.lexsort((rows["entry"], rows["_block"]))
    block, entry, end = (rows[c][order] for c in ("_block", "entry", "exit"))
    delay = int(rows["_delay"][0])
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    opens = np.empty(len(starts), dtype=np.int64)
    open_from = np.iinfo(np.int64).min
    for i, (lo, hi) in enumerate(zip(starts, np.append(starts[1:], len(block)))):
        opens[i] = open_from
        at = lo + int(np.searchsorted(entry[lo:hi], open_from))
        if at < hi:
            open_from = int(end[at]) + delay
    return block[starts], opens


def _emit(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    return (respond(np.sort(rows["_us"]), int(rows["_delay"][0]), int(rows["_open"][0])),)


def _per_key(fn, keys: list[str], columns: list[str]):
    """Apply ``fn`` to the columns of every key of a pack, and put the key in front."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(keys, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        pdf, code = pdf.iloc[order], code[order]
        values = {c: pdf[c].to_numpy() for c in pdf.columns if c not in keys}
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        found = [
            fn({c: v[lo:hi] for c, v in values.items()})
            for lo, hi in zip(starts, np.append(starts[1:], len(code)))
        ]
        rows = np.repeat(starts, [len(part[0]) for part in found])
        out = pdf[keys].iloc[rows].reset_index(drop=True)
        for i, name in enumerate(columns):
            out[name] = np.concatenate([part[i] for part in found])
        return out

    return run


def _pack_count(df: DataFrame) -> tuple[int, int]:
    """Packs for the rows at hand, and the tasks that work on them.

    The number of packs follows the rows without bound, so the groups that reach pandas
    keep their size; every core is busy, and there are no more tasks than a shuffle has.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    packs = max(cores, df.count() // PACK_ROWS + 1)
    return packs, min(packs, max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def throttle(df: DataFrame, keys: list[str], time_us: str, delay_us: str) -> DataFrame:
    """Distinct (keys, time_us) that respond.

    ``time_us`` and ``delay_us`` are microseconds; the delay is positive and the
    same for all rows of a key.  Keys must not be NULL.  ``df`` should be
    materialised, since it is counted once and read twice.
    """
    packs, tasks = _pack_count(df)
    instants = (
        df.select(*keys, F.col(time_us).alias("_us"), F.col(delay_us).alias("_delay"))
        .withColumn("_block", F.floor(F.col("_us") / (F.col("_delay") * BLOCK_DELAYS)).cast("bigint"))
        .withColumn("_pack", F.pmod(F.xxhash64(*keys), F.lit(packs)))
    )
    kept = [f for f in instants.schema if f.name in keys]

    def apply(groups, fn, *extra: str) -> DataFrame:
        schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in extra]])
        return groups.applyInPandas(_per_key(fn, [f.name for f in kept], list(extra)), schema)

    def grouped(rows: DataFrame, *by: str):
        # the fixed number keeps AQE from merging the groups into a few tasks: the
        # Python work per row is far above what their bytes suggest
        return rows.repartition(tasks, *by).groupBy(*by)

    block = ["_pack", "_delay", "_block"]
    steps = apply(grouped(instants, *block), _steps, "_block", "_delay", "entry", "exit")
    steps = steps.withColumn("_pack", F.pmod(F.xxhash64(*keys), F.lit(packs)))
    opens = apply(grouped(steps, "_pack"), _chain, "_block", "_open")
    entered = instants.join(opens, [*keys, "_block"])
    return apply(grouped(entered, *block), _emit, "_us").withColumnRenamed("_us", time_us)
