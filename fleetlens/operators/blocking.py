"""Blocking-chain analysis of blocked-process reports.

All chain work is keyed by (server_name, monitor_loop, spid).  Chain metrics are
counted from the ends of the chains towards their leads, over one row per blocking
session and hop; paths are never listed, so a session that blocks a third of the
fleet costs one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.joins import small_side
from fleetlens.functions.numbers import int_div
from fleetlens.session import cut

LOOP = ["server_name", "monitor_loop"]


def blocked_process_dedupe(edges: DataFrame, *, now: Column, hours: int = 48) -> DataFrame:
    """One row per (loop, blocker, victim): the lowest id of the last hours.

    Sessions that block themselves, and pairs with an unknown side, are dropped.
    """
    pair = [*LOOP, "blk_spid", "vic_spid"]
    rest = [c for c in edges.columns if c not in (*pair, "blocked_process_id")]
    oldest = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    return (
        edges.where((F.col("blk_spid") != F.col("vic_spid")) & (F.col("post_time") >= oldest))
        .groupBy(*pair)
        .agg(
            F.min("blocked_process_id").alias("blocked_process_id"),
            *[F.min_by(c, "blocked_process_id").alias(c) for c in rest],
        )
        .select(*edges.columns)
    )


def lead_blockers(edges: DataFrame) -> DataFrame:
    """Flag rows whose blocker is no victim in the same loop.

    An unknown victim in a loop leaves no row of that loop flagged, as NOT IN
    with a NULL does.  The rows are read three times and therefore materialised
    first: the reports behind them are parsed once.
    """
    edges = cut(edges)
    victims = (
        edges.where(F.col("vic_spid").isNotNull())
        .select(*LOOP, F.col("vic_spid").alias("blk_spid"), F.lit(True).alias("_blocked")).distinct()
    )
    # loops with an unknown victim are rare, which the measured size decides
    unknown = small_side(
        edges.where(F.col("vic_spid").isNull()).select(*LOOP, F.lit(True).alias("_unknown")).distinct()
    )
    lead = F.col("_blocked").isNull() & F.col("_unknown").isNull() & F.col("blk_spid").isNotNull()
    return (
        edges.join(victims, [*LOOP, "blk_spid"], "left")
        .join(unknown, LOOP, "left")
        .select(*edges.columns, lead.alias("is_lead_blocker"))
    )


def _chain_sums(chained: DataFrame) -> DataFrame:
    """Per blocking session the number of paths below it and the sum of their last hops.

    A session has the sum over its victims of one more than the victim's own count.  Every
    round adds up the victims that are settled and, so that a long chain takes few
    rounds, replaces a victim with a single open victim by that one.  A round that settles
    none leaves the sessions on or above a cycle, which have no end: they are ``endless`` and
    have no figures.  Counts beyond the range of a long are null.
    """
    node = [*LOOP, "v"]
    sessions = cut(
        chained.groupBy(*LOOP, F.col("blk_spid").alias("v")).agg(F.count("*").alias("paths"), F.sum("duration_ms").alias("total"))
    )
    victims = sessions.select(*LOOP, F.col("v").alias("w"))
    hops = chained.select(*LOOP, F.col("blk_spid").alias("v"), F.col("vic_spid").alias("w")).join(victims, [*LOOP, "w"], "left_semi")
    hops = cut(hops.groupBy(*LOOP, "v", "w").agg(F.count("*").alias("m")))
    while not hops.isEmpty():
        out = hops.groupBy(*node).agg(F.count("*").alias("_open"), F.first("w").alias("_next"), F.first("m").alias("_by"))
        out = out.withColumnRenamed("v", "w")
        below = sessions.select(*LOOP, F.col("v").alias("w"), F.col("paths").alias("_paths"), F.col("total").alias("_total"))
        seen = cut(hops.join(below, [*LOOP, "w"]).join(out, [*LOOP, "w"], "left"))
        if seen.where("_open IS NULL").isEmpty():
            break
        taken = seen.where("coalesce(_open, 1) = 1")
        gained = taken.groupBy(*node).agg(
            F.try_sum(F.try_multiply("m", F.col("_paths"))).alias("_p"), F.try_sum(F.try_multiply("m", F.col("_total"))).alias("_t"), F.lit(True).alias("_gained")
        )
        sessions = cut(sessions.join(gained, node, "left").select(
            *node, *[
                F.when(F.col("_gained").isNull(), F.col(c)).otherwise(F.try_add(c, F.col(g))).alias(c) for c, g in (("paths", "_p"), ("total", "_t"))
            ]
        ))
        kept = seen.where("_open > 1").select(*node, "w", "m")
        jumped = seen.where("_open = 1").select(*node, F.col("_next").alias("w"), F.try_multiply("m", F.col("_by")).alias("m"))
        hops = cut(kept.unionByName(jumped).groupBy(*LOOP, "v", "w").agg(F.try_sum("m").alias("m")))
    endless = hops.select(*node).distinct().withColumn("endless", F.lit(True))
    return sessions.join(endless, node, "left").withColumnRenamed("v", "vic_spid")


def blocking_chain_metrics(edges: DataFrame) -> DataFrame:
    """Sessions blocked, total and average duration for each lead row, longest total first.

    The input is the flagged output of ``lead_blockers``.  A victim reached over
    two paths counts twice; paths are counted, never listed.  A lead whose chain runs into a
    cycle has ``chain_status`` 'cycle' and no figures; all others are 'complete'.  The rows are
    read several times and therefore materialised first.
    """
    edges = cut(edges)
    chained = edges.where(~F.col("is_lead_blocker")).select(*LOOP, "blk_spid", "vic_spid", "duration_ms")
    below = _chain_sums(chained)
    count = F.when(F.col("_below").isNull(), F.lit(1).cast("bigint")).otherwise(F.try_add(F.col("paths"), F.lit(1)))
    total = F.when(F.col("_below").isNull(), F.col("duration_ms")).otherwise(F.try_add("duration_ms", F.col("total")))
    ends = F.col("endless").isNull()
    leads = edges.where("is_lead_blocker").join(below.withColumn("_below", F.lit(True)), [*LOOP, "vic_spid"], "left").select(
        *edges.columns, F.when(ends, count).alias("spids_blocked"), F.when(ends, total).alias("total_duration_ms"),
        F.when(ends, int_div(total, count)).alias("avg_duration_ms"), F.when(ends, "complete").otherwise("cycle").alias("chain_status"),
    )
    return leads.orderBy(F.desc("total_duration_ms"), *LOOP, "blocked_process_id")


def blocking_cycles(edges: DataFrame) -> DataFrame:
    """The sessions that block each other in a circle: one row a session, with its cycle and the cycle's size.

    A cycle is a strongly connected component, named by its lowest session.  Only what
    lies on or above a cycle is looked at: what ends has been settled before.  Every pass hands the
    highest session down the chains; sessions that reach the one whose mark they carry form its
    cycle.  Marked cycles leave, and the rest takes part in the next pass.  Rounds follow
    the longest way inside a cycle and above it.  Cycles have no lead, so all edges count.
    """
    pairs = edges.where(F.col("blk_spid").isNotNull() & F.col("vic_spid").isNotNull() & (F.col("blk_spid") != F.col("vic_spid")))
    pairs = cut(pairs.select(*LOOP, "blk_spid", "vic_spid"))  # read several times below
    endless = _chain_sums(pairs.select(*LOOP, "blk_spid", "vic_spid", F.lit(0).cast("bigint").alias("duration_ms")))
    endless = cut(endless.where("endless").select(*LOOP, F.col("vic_spid").alias("v")))
    arcs = pairs.select(*LOOP, F.col("blk_spid").alias("v"), F.col("vic_spid").alias("w")).distinct()
    arcs = cut(arcs.join(endless, [*LOOP, "v"], "left_semi").join(endless.withColumnRenamed("v", "w"), [*LOOP, "w"], "left_semi"))
    found = None
    while not arcs.isEmpty():
        marks = arcs.select(*LOOP, "v").union(arcs.select(*LOOP, "w")).distinct().withColumn("mark", F.col("v"))
        marks = _spread(cut(marks), arcs.select(*LOOP, F.col("v").alias("from"), F.col("w").alias("v")))
        side = lambda c: marks.select(*LOOP, F.col("v").alias(c), F.col("mark").alias(f"_{c}"))  # noqa: B023, E731
        inside = cut(arcs.join(side("v"), [*LOOP, "v"]).join(side("w"), [*LOOP, "w"]).where("_v = _w"))
        # from the session of the mark back up the chains that carry it
        reached = cut(marks.where("v = mark"))
        while True:
            more = inside.join(reached.select(*LOOP, F.col("v").alias("w")), [*LOOP, "w"]).select(*LOOP, "v", F.col("_v").alias("mark"))
            more = cut(more.distinct().join(reached, [*LOOP, "v"], "left_anti"))
            if more.isEmpty():
                break
            reached = cut(reached.unionByName(more))
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select(*LOOP, "v")
        arcs = cut(arcs.join(gone, [*LOOP, "v"], "left_anti").join(gone.withColumnRenamed("v", "w"), [*LOOP, "w"], "left_anti"))
    if found is None:
        found = endless.withColumn("mark", F.col("v"))  # no rows
    cycles = found.groupBy(*LOOP, "mark").agg(F.min("v").alias("cycle_id"), F.count("*").alias("sessions")).where("sessions > 1")
    return found.join(cycles, [*LOOP, "mark"]).select(*LOOP, "cycle_id", "sessions", F.col("v").alias("spid"))


def _spread(marks: DataFrame, arcs: DataFrame) -> DataFrame:
    """The highest mark that reaches each session over arcs (from, v)."""
    while True:
        offers = arcs.join(marks.select(*LOOP, F.col("v").alias("from"), "mark"), [*LOOP, "from"]).groupBy(*LOOP, "v").agg(F.max("mark").alias("_offer"))
        after = cut(marks.join(offers, [*LOOP, "v"], "left").select(
            *LOOP, "v", F.greatest("mark", "_offer").alias("mark"), (F.col("_offer") > F.col("mark")).alias("_moved")
        ))
        marks = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return marks
