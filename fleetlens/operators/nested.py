"""Nested documents, dependencies and task metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.functions.joins import reduced_side
from fleetlens.session import cut
from fleetlens.sources import schemas as s

DB = ["server_name", "database_name"]
REPORT_DATABASES = ("ReportServer", "ReportServerTempDB")
# fixed values: databases whose modules are not examined, and module kinds
SKIPPED_DATABASES = ("master", "model", "msdb", "tempdb", "SSISDB", "distribution")
REFERENCED = ["referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name"]
NODE = ["server_name", "database_name", "schema_name", "object_name"]
MODULE_TYPES = ("P", "FN", "IF", "TF", "V", "TR")


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """Assessment documents, one per file, with the fixed schema."""
    return spark.read.schema(s.ASSESSMENT).option("multiLine", True).json(path)


def parse_assessments(documents: DataFrame, column: str = "document") -> DataFrame:
    """The same from a text column."""
    return documents.select(F.inline(F.array(F.from_json(column, s.ASSESSMENT))))


def _recommendations(documents: DataFrame) -> DataFrame:
    """Database and recommendation levels; empty arrays give no row."""
    return documents.select(F.explode("Databases").alias("d")).select(
        F.col("d.Name").alias("database_name"), F.col("d.CompatibilityLevel").alias("compatibility_level"),
        F.explode("d.AssessmentRecommendations").alias("r"),
    )


def _issues(documents: DataFrame) -> DataFrame:
    r = {
        "migrating_to": "CompatibilityLevel", "category": "Category", "severity": "Severity", "change_category": "ChangeCategory",
        "title": "Title", "impact": "Impact", "recommendation": "Recommendation", "reference": "MoreInfo",
    }
    return _recommendations(documents).select(
        "database_name", "compatibility_level", *[F.col(f"r.{path}").alias(name) for name, path in r.items()],
        F.explode("r.ImpactedObjects").alias("i"),
    ).select(
        "*", F.col("i.Name").alias("object_name"), F.col("i.ObjectType").alias("object_type"), F.col("i.ImpactDetail").alias("impact_detail"),
    ).drop("i")


def dma_issue_summary(documents: DataFrame) -> DataFrame:
    """Distinct issues of all objects, counted per issue text."""
    issue = ["category", "severity", "change_category", "title", "impact", "recommendation", "reference"]
    distinct = _issues(documents).drop("migrating_to").distinct()
    return distinct.groupBy(*issue).agg(F.count("*").alias("issue_count"))


def dma_issue_details(documents: DataFrame, *, exclude: tuple[str, ...] = REPORT_DATABASES) -> DataFrame:
    """One row per impacted object, in title order, then by object."""
    return _issues(documents).where(~F.col("database_name").isin(*exclude)).select(
        "database_name", "compatibility_level", "migrating_to", "title", "object_name", "object_type",
        F.col("impact_detail").alias("more_info"),
    ).orderBy("title", "database_name", "object_name", "object_type", "migrating_to", "more_info")


def dma_summary_headers(documents: DataFrame, *, exclude: tuple[str, ...] = REPORT_DATABASES) -> DataFrame:
    """Text block per issue with the lowest target level; NULL if any part is."""
    rows = _recommendations(documents).where(~F.col("database_name").isin(*exclude)).select("r.*")
    issue = ["Category", "ChangeCategory", "Severity", "Title", "Impact", "Recommendation", "MoreInfo"]
    low = rows.groupBy(*issue).agg(F.min("CompatibilityLevel").alias("low"))
    nl = F.lit(tx.CRLF)
    block = F.concat(
        F.lit("Title: "), "Title", nl, F.lit("Category: "), "Category", F.lit(" ("), "ChangeCategory", F.lit(")"), nl,
        F.lit("Severity: "), "Severity", nl, F.lit("Impact: "), "Impact", nl, F.lit("Recommendation: "), "Recommendation", nl,
        F.lit("More Info: "), "MoreInfo", nl, F.lit("Applies to: "), "low", F.lit(" (or higher)"),
    )
    return low.select(block.alias("header"))


def union_sources(sources: dict[str, DataFrame], *, skip: tuple[str, ...] = (), tag: str = "database_name") -> DataFrame:
    """One table out of one DataFrame per source, tagged by its name."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in sources.items() if name not in skip]
    if not parts:
        raise ValueError("no source is left")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usable_databases(databases: DataFrame) -> DataFrame:
    """Databases a fan-out visits: online, writable, no snapshot, no system database."""
    return databases.where(
        (F.col("state_desc") == "ONLINE") & (F.col("is_read_only") == 0) & F.col("source_database_guid").isNull()
        & ~F.col("database_name").isin("master", "model", "msdb", "tempdb")
    ).select(*DB)


def fan_out_union(rows: DataFrame, databases: DataFrame) -> DataFrame:
    """The fan-out over one table that already holds all databases: a semi join."""
    return rows.join(usable_databases(databases), DB, "left_semi")


def dependency_union(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """Expression dependencies of all databases, vendor objects left out."""
    own = modules.where("is_ms_shipped = 0").select(*DB, "schema_name", "object_name")
    return dependencies.join(own, [*DB, "schema_name", "object_name"], "left_semi").select(
        *DB, "schema_name", "object_name", *REFERENCED
    )


def dependency_closure(dependencies: DataFrame, *, default_schema: str = "dbo") -> DataFrame:
    """All objects that each object depends on, directly or through others.

    A reference without a server, database or schema means that of the object, and the default
    schema.  Names are compared without regard to case.  Returns the object (server_name,
    database_name, schema_name, object_name), what it needs (needed_*), ``depth``, the fewest steps
    to it, and ``in_cycle``, whether the object needs itself.

    The search runs on numbers of the objects.  Every round extends the pairs that the round
    before found, less those of the two rounds before; pairs of all rounds are left out at depths 4, 8, 16, ...
    and the fewest steps are taken at the end.  So the pairs found so far are moved a few times and not in
    every round; what is found again in between, over ways of other lengths, ends at the next such depth.
    """
    own = lambda c, d: F.lower(F.coalesce(F.col(c), d))
    source = [F.lower(c).alias(c) for c in NODE]
    target = [
        own("referenced_server_name", F.col("server_name")).alias("needed_server_name"),
        own("referenced_database_name", F.col("database_name")).alias("needed_database_name"),
        own("referenced_schema_name", F.lit(default_schema)).alias("needed_schema_name"),
        F.lower("referenced_entity_name").alias("needed_object_name"),
    ]
    needed = [f"needed_{c}" for c in NODE]
    edges = cut(dependencies.select(*source, *target).dropna().distinct())
    objects = edges.select(*NODE).union(edges.select(*needed)).distinct()
    objects = cut(objects.withColumn("a", F.monotonically_increasing_id()))  # numbers stay as they are once cut
    others = objects.select(F.col("a").alias("b"), *[F.col(c).alias(f"needed_{c}") for c in NODE])
    edges = cut(edges.join(objects, NODE).join(others, needed).select("a", "b"))
    step = edges.where("a <> b").select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = [edges]
    while not found[-1].isEmpty():
        depth = len(found) + 1
        known = found if depth >= 4 and depth & (depth - 1) == 0 else found[-2:]
        further = found[-1].join(step, "b").select("a", F.col("c").alias("b")).distinct()
        found.append(cut(further.join(reduce(DataFrame.union, known), ["a", "b"], "left_anti")))
    pairs = reduce(DataFrame.union, [rows.withColumn("depth", F.lit(i)) for i, rows in enumerate(found, 1)])
    circles = pairs.where("a = b").select("a", F.lit(True).alias("_circle")).distinct()
    # dealt by object once, for the fewest steps and for its names
    pairs = pairs.repartition("a").groupBy("a", "b").agg(F.min("depth").alias("depth"))
    named = pairs.join(objects, "a").join(reduced_side(circles), "a", "left").join(others, "b")
    return named.select(*NODE, *needed, "depth", F.coalesce("_circle", F.lit(False)).alias("in_cycle"))


def referenced_entities_collect(references: DataFrame, read_only: DataFrame) -> DataFrame:
    """Collected references without system and read-only databases, column-level rows and flags included.

    Rows of a module that failed are dropped silently.
    """
    named = ~F.col("database_name").isin(*SKIPPED_DATABASES) & ~F.col("database_name").like("ReportServer%")
    failed = references.where(F.col("err_msg").isNotNull()).select(*DB, "schema_name", "object_name").distinct()
    return (
        references.where(named).join(read_only.select(*DB), DB, "left_anti")
        .join(failed, [*DB, "schema_name", "object_name"], "left_anti").drop("err_msg")
    )


def invalid_module_report(modules: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Refreshable modules whose refresh failed, with the error text."""
    wanted = modules.where(
        F.col("type").isin(*MODULE_TYPES) & (F.col("is_ms_shipped") == 0) & (F.coalesce("is_schema_bound", F.lit(0)) == 0)
    ).select(*DB, "schema_name", "object_name", "type")
    errors = refreshes.where(F.col("err_msg").isNotNull()).select(*DB, "schema_name", "object_name", "err_msg").distinct()
    return wanted.join(errors, [*DB, "schema_name", "object_name"])


def task_type(name: Column) -> Column:
    """Last segment of a dotted type name."""
    return F.substring_index(name, ".", -1)


PACKAGE_SCHEMA = (
    "catalog_name string, folders array<struct<name string, projects array<struct<name string, "
    "packages array<struct<package_id bigint, tasks array<struct<task_id bigint, type string, name string, description string>>>>>>>>"
)


def flatten_packages(catalogs: DataFrame) -> DataFrame:
    """Task rows of nested catalog documents (folders, projects, packages, tasks)."""
    return (
        catalogs.select("catalog_name", F.explode("folders").alias("f"))
        .select("catalog_name", F.col("f.name").alias("folder_name"), F.explode("f.projects").alias("p"))
        .select("catalog_name", "folder_name", F.col("p.name").alias("project_name"), F.explode("p.packages").alias("k"))
        .select("catalog_name", "folder_name", "project_name", F.col("k.package_id").alias("package_id"), F.explode("k.tasks").alias("t"))
        .select(
            "catalog_name", "folder_name", "project_name", "package_id", F.col("t.task_id").alias("task_id"),
            F.col("t.type").alias("task_type"), F.col("t.name").alias("task_name"), F.col("t.description").alias("task_description"),
        )
    )


def precedence_chain_order(edges: DataFrame) -> DataFrame:
    """Position of each edge along the chain of its package, from 1.

    The head is the first edge (by index) whose predecessor follows nothing; from
    an edge the chain goes on with the first edge that starts where it ends, and it
    stops at a gap.  A chain that turns into a cycle keeps the first position of
    each edge.  Positions come from pointer doubling: each round doubles the jump
    of every edge and the reached part of every chain, so a chain of n edges takes
    log2(n) rounds of joins and never sits in one task.
    """
    key = ["package_id"]
    first = edges.groupBy(*key, F.col("from_task").alias("to_task")).agg(F.min("edge_index").alias("jump"))
    pointers = cut(edges.join(first, [*key, "to_task"], "left").select(*key, "edge_index", "from_task", "to_task", "jump"))
    heads = (
        pointers.join(pointers.select(*key, F.col("to_task").alias("from_task")).distinct(), [*key, "from_task"], "left_anti")
        .groupBy(*key).agg(F.min("edge_index").alias("edge_index"))
    )
    reached = heads.select(*key, "edge_index", F.lit(1).cast("bigint").alias("position"))
    jumps = pointers.select(*key, "edge_index", "jump").where(F.col("jump").isNotNull())
    step, known = 1, -1
    reached = cut(reached)
    while True:
        moved = reached.join(jumps, [*key, "edge_index"]).select(
            *key, F.col("jump").alias("edge_index"), (F.col("position") + step).alias("position")
        )
        reached = cut(reached.unionByName(moved).groupBy(*key, "edge_index").agg(F.min("position").alias("position")))
        size = reached.count()
        if size == known:
            break
        known = size
        far = jumps.select(*key, F.col("edge_index").alias("jump"), F.col("jump").alias("far"))
        jumps = cut(jumps.join(far, [*key, "jump"]).select(*key, "edge_index", F.col("far").alias("jump")))
        step *= 2
    return pointers.join(reached, [*key, "edge_index"]).select(*key, "edge_index", "from_task", "to_task", "position")


def task_order(edges: DataFrame) -> DataFrame:
    """Order of the tasks of a chain: the head's predecessor is 1, its successor 2.

    A task the chain passes twice keeps its first order.
    """
    chain = precedence_chain_order(edges)
    head = chain.where("position = 1").select("package_id", F.col("from_task").alias("task_id"), F.lit(1).cast("bigint").alias("task_order"))
    rest = chain.select("package_id", F.col("to_task").alias("task_id"), (F.col("position") + 1).alias("task_order"))
    return head.unionByName(rest).groupBy("package_id", "task_id").agg(F.min("task_order").alias("task_order"))


def ssis_task_flatten(tasks: DataFrame, order: DataFrame) -> DataFrame:
    """Eight text columns per task; tasks outside the chain have an empty order."""
    return tasks.join(order, ["package_id", "task_id"], "left").select(
        "catalog_name", "folder_name", "project_name", F.col("package_id").cast("string").alias("package_name"),
        task_type(F.col("task_type")).alias("task_type"), "task_name",
        F.coalesce(F.col("task_order").cast("string"), F.lit("")).alias("task_order"), "task_description",
    )
