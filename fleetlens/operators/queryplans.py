"""Missing-index findings from query runtime statistics and plan XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DB = ["server_name", "database_name"]
PLAN = [*DB, "plan_id"]


def costly_plans(
    runtime: DataFrame, *, now: Column, hours: int = 24, min_cpu_ms: float = 10_000
) -> DataFrame:
    """Totals per plan of the last hours, cheap plans dropped."""
    recent = runtime.where(F.col("last_execution_time") > now - F.expr(f"INTERVAL {int(hours)} HOURS"))

    def total_ms(average: str) -> Column:
        micros = F.sum(F.col("count_executions") * F.col(average)).cast("decimal(30,0)")
        return (micros / F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,2)")

    return recent.groupBy(*PLAN).agg(
        F.sum("count_executions").alias("count_executions"),
        total_ms("avg_duration_us").alias("total_duration_ms"),
        total_ms("avg_cpu_us").alias("total_cpu_time_ms"),
    ).where(F.col("total_cpu_time_ms") >= min_cpu_ms)


_SUGGESTION = r"<(?:[\w.-]+:)?MissingIndexes[\s>]"


def _attribute(text: Column, element: str, name: str) -> Column:
    """Value of the first attribute of that name on such an element, or NULL."""
    pattern = rf"""<{element}\s(?:[^<>]*?\s)?{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(reference), F.lit(character))
    return value


def missing_index_plans(
    runtime: DataFrame, plans: DataFrame, queries: DataFrame, *, now: Column, hours: int = 24, min_cpu_ms: float = 10_000
) -> DataFrame:
    """Statements of costly plans that carry a missing-index suggestion.

    Cheap plans go first and the text is tested for the node.  Every simple
    statement of such a plan, at any depth, gives a row; one without a suggestion of
    its own has NULL names.  A statement's own query plan comes before the statements
    nested in it, so the text up to the next statement border is all there is to read.
    """
    costly = costly_plans(runtime, now=now, hours=hours, min_cpu_ms=min_cpu_ms)
    texts = plans.where(F.col("query_plan").rlike(_SUGGESTION)).join(costly, PLAN)
    plain = F.regexp_replace("query_plan", r"<(/?)[\w.-]+:", "<$1")  # names without prefix
    # all that lies between the start of a statement and the next start or end of one
    pieces = F.split(plain, r"<StmtSimple(?=[\s>])")
    own = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.substring_index(x, "</StmtSimple", 1))
    rows = texts.select(
        *PLAN, "query_id", "count_executions", "total_duration_ms", "total_cpu_time_ms", F.explode(own).alias("stmt")
    )
    found = F.regexp_extract("stmt", r"(?s)<MissingIndexes[\s>](.*?)</MissingIndexes", 1)
    return rows.join(queries, [*DB, "query_id"]).select(
        *PLAN, "query_id", "object_name", "query_sql_text", _attribute(found, "MissingIndex", "Database").alias("missing_database"),
        _attribute(found, "MissingIndex", "Schema").alias("missing_schema"), _attribute(found, "MissingIndex", "Table").alias("missing_table"),
        _attribute(found, "MissingIndexGroup", "Impact").try_cast("double").alias("impact"),
        "count_executions", "total_duration_ms", "total_cpu_time_ms",
    )
