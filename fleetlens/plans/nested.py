"""Documents, dependencies and task metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import nested as n
from fleetlens.plans.registry import query


def _documents(t):
    """Assessment documents of at most fifty objects each, built from the flat rows."""
    flat = t("fx_assessment")
    objects = flat.groupBy("document_id", "database_name", "compatibility_level", "title", "severity", "impact", "migrating_to").agg(
        F.collect_list(F.struct(F.col("object_type").alias("ObjectType"), F.col("object_name").alias("Name"), F.col("impact_detail").alias("ImpactDetail"))).alias("ImpactedObjects")
    )
    recommendation = F.struct(
        F.col("migrating_to").alias("CompatibilityLevel"), F.lit("Compatibility").alias("Category"), F.col("severity").alias("Severity"), F.lit("Breaking").alias("ChangeCategory"),
        F.col("title").alias("Title"), F.col("impact").alias("Impact"), F.lit("fix it").alias("Recommendation"), F.lit("see docs").alias("MoreInfo"), "ImpactedObjects",
    )
    databases = objects.groupBy("document_id", "database_name", "compatibility_level").agg(F.collect_list(recommendation).alias("AssessmentRecommendations"))
    one = F.struct(F.col("database_name").alias("Name"), F.col("compatibility_level").alias("CompatibilityLevel"), "AssessmentRecommendations")
    return n.parse_assessments(databases.select(F.to_json(F.struct(F.array(one).alias("Databases"))).alias("document")))


@query("dma_issue_summary", """
SELECT count(*) AS issue_count, 'Compatibility' AS category, severity, 'Breaking' AS change_category, title, impact, 'fix it' AS recommendation, 'see docs' AS reference
FROM (SELECT DISTINCT database_name, compatibility_level, severity, title, impact, object_name, object_type, impact_detail FROM fx_assessment) GROUP BY severity, title, impact
""")
def dma_issue_summary(t):
    return n.dma_issue_summary(_documents(t))


@query("dma_issue_details", "SELECT database_name, compatibility_level, migrating_to, title, object_name, object_type, impact_detail AS more_info FROM fx_assessment")
def dma_issue_details(t):
    return n.dma_issue_details(_documents(t))


@query("dma_summary_headers", """
SELECT 'Title: ' || title || chr(13) || chr(10) || 'Category: Compatibility (Breaking)' || chr(13) || chr(10) || 'Severity: ' || severity || chr(13) || chr(10) || 'Impact: ' || impact || chr(13) || chr(10) || 'Recommendation: fix it' || chr(13) || chr(10)
  || 'More Info: see docs' || chr(13) || chr(10) || 'Applies to: ' || min(migrating_to) || ' (or higher)' AS header FROM fx_assessment GROUP BY title, severity, impact
""")
def dma_summary_headers(t):
    return n.dma_summary_headers(_documents(t))


@query("dependency_union", """
SELECT d.server_name, d.database_name, d.schema_name, d.object_name, d.referenced_server_name, d.referenced_database_name, d.referenced_schema_name, d.referenced_entity_name FROM fx_dependency d
WHERE EXISTS (SELECT 1 FROM fx_module m WHERE m.is_ms_shipped = 0 AND m.server_name = d.server_name AND m.database_name = d.database_name AND m.object_name = d.object_name)
""")
def dependency_union(t):
    return n.dependency_union(t("fx_dependency"), t("fx_module"))


@query("dependency_closure", """
WITH RECURSIVE e AS (SELECT DISTINCT server_name AS s, database_name AS d, schema_name AS c, object_name AS o, coalesce(referenced_server_name, server_name) AS s2, coalesce(referenced_database_name, database_name) AS d2,
  coalesce(referenced_schema_name, 'dbo') AS c2, referenced_entity_name AS o2 FROM fx_object_reference),
r AS (SELECT *, 1 AS depth FROM e UNION SELECT r.s, r.d, r.c, r.o, e.s2, e.d2, e.c2, e.o2, r.depth + 1 FROM r JOIN e ON e.s = r.s2 AND e.d = r.d2 AND e.c = r.c2 AND e.o = r.o2 WHERE r.depth < 40),
m AS (SELECT s, d, c, o, s2, d2, c2, o2, min(depth) AS depth FROM r GROUP BY ALL)
SELECT s AS server_name, d AS database_name, c AS schema_name, o AS object_name, s2 AS needed_server_name, d2 AS needed_database_name, c2 AS needed_schema_name, o2 AS needed_object_name, depth,
  EXISTS (SELECT 1 FROM m x WHERE x.s = m.s AND x.d = m.d AND x.c = m.c AND x.o = m.o AND x.s2 = m.s AND x.d2 = m.d AND x.c2 = m.c AND x.o2 = m.o) AS in_cycle FROM m
""")
def dependency_closure(t):
    """What every object depends on through others, over databases and servers."""
    return n.dependency_closure(t("fx_object_reference"))


@query("referenced_entities_collect", """
SELECT server_name, database_name, schema_name, object_name, referencing_minor_id, referenced_server_name, referenced_database_name, referenced_schema_name, referenced_entity_name, referenced_minor_name, referenced_id,
  referenced_minor_id, referenced_class, referenced_class_desc, is_caller_dependent, is_ambiguous, is_selected, is_updated, is_select_all, is_all_columns_found, is_insert_all, is_incomplete FROM fx_dependency d
WHERE NOT EXISTS (SELECT 1 FROM fx_databases b WHERE b.is_read_only = 1 AND b.server_name = d.server_name AND b.database_name = d.database_name)
  AND NOT EXISTS (SELECT 1 FROM fx_dependency f WHERE f.err_msg IS NOT NULL AND f.server_name = d.server_name AND f.database_name = d.database_name AND f.object_name = d.object_name)
""")
def referenced_entities_collect(t):
    return n.referenced_entities_collect(t("fx_dependency"), t("fx_databases").where("is_read_only = 1"))


@query("invalid_module_report", """
SELECT DISTINCT m.server_name, m.database_name, m.schema_name, m.object_name, m.type, d.err_msg FROM fx_module m JOIN fx_dependency d ON d.server_name = m.server_name AND d.database_name = m.database_name AND d.object_name = m.object_name
WHERE m.type IN ('P', 'FN', 'IF', 'TF', 'V', 'TR') AND m.is_ms_shipped = 0 AND coalesce(m.is_schema_bound, 0) = 0 AND d.err_msg IS NOT NULL
""")
def invalid_module_report(t):
    return n.invalid_module_report(t("fx_module"), t("fx_dependency"))


@query("fan_out_union", """
SELECT a.* FROM fx_allocation a JOIN fx_databases d ON d.server_name = a.server_name AND d.database_name = a.database_name
WHERE d.state_desc = 'ONLINE' AND d.is_read_only = 0 AND d.source_database_guid IS NULL AND d.database_name NOT IN ('master', 'model', 'msdb', 'tempdb')
""")
def fan_out_union(t):
    return n.fan_out_union(t("fx_allocation"), t("fx_databases"))


_CHAIN = """
firsts AS (SELECT package_id, from_task AS to_task, min(edge_index) AS following FROM fx_precedence GROUP BY 1, 2),
linked AS (SELECT e.*, f.following FROM fx_precedence e LEFT JOIN firsts f ON f.package_id = e.package_id AND f.to_task = e.to_task),
heads AS (SELECT package_id, min(edge_index) AS edge_index FROM fx_precedence e WHERE NOT EXISTS (SELECT 1 FROM fx_precedence p WHERE p.package_id = e.package_id AND p.to_task = e.from_task) GROUP BY 1),
chain AS (SELECT package_id, edge_index, cast(1 AS bigint) AS position FROM heads UNION ALL SELECT l.package_id, l.following, c.position + 1 FROM chain c JOIN linked l ON l.package_id = c.package_id AND l.edge_index = c.edge_index WHERE l.following IS NOT NULL),
placed AS (SELECT e.package_id, e.edge_index, e.from_task, e.to_task, c.position FROM fx_precedence e JOIN chain c ON c.package_id = e.package_id AND c.edge_index = e.edge_index)
"""


@query("precedence_chain_order", f"WITH RECURSIVE {_CHAIN} SELECT * FROM placed")
def precedence_chain_order(t):
    return n.precedence_chain_order(t("fx_precedence"))


@query("ssis_task_flatten", f"""
WITH RECURSIVE {_CHAIN}, ordered AS (SELECT package_id, task_id, min(task_order) AS task_order FROM (SELECT package_id, from_task AS task_id, 1 AS task_order FROM placed WHERE position = 1 UNION ALL SELECT package_id, to_task, position + 1 FROM placed) GROUP BY 1, 2)
SELECT t.catalog_name, t.folder_name, t.project_name, cast(t.package_id AS varchar) AS package_name, split_part(t.task_type, '.', -1) AS task_type, t.task_name, coalesce(cast(o.task_order AS varchar), '') AS task_order, t.task_description
FROM fx_task t LEFT JOIN ordered o ON o.package_id = t.package_id AND o.task_id = t.task_id
""")
def ssis_task_flatten(t):
    tasks = t("fx_task")
    task = F.struct("task_id", F.col("task_type").alias("type"), F.col("task_name").alias("name"), F.col("task_description").alias("description"))
    # a document holds one package, or fifty tasks of a long one
    where = ["catalog_name", "folder_name", "project_name", "package_id", F.floor(F.col("task_id") / 50).alias("part")]
    package = F.struct("package_id", "tasks")
    project = F.struct(F.col("project_name").alias("name"), F.array(package).alias("packages"))
    folder = F.struct(F.col("folder_name").alias("name"), F.array(project).alias("projects"))
    documents = tasks.groupBy(*where).agg(F.collect_list(task).alias("tasks")).select("catalog_name", F.array(folder).alias("folders"))
    return n.ssis_task_flatten(n.flatten_packages(documents), n.task_order(t("fx_precedence")))
