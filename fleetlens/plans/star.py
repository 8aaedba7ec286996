"""Star-schema family."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import star as s
from fleetlens.plans.registry import query


@query("column_cardinality", """
SELECT 'o_orderpriority' AS dimension, o_orderpriority AS name, count(*) AS row_count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
""")
def column_cardinality(t):
    return s.column_cardinality(t("orders"))


@query("dimension_columns", """
SELECT 'lang' AS dimension, 'langKey' AS key_name, count(DISTINCT lang) AS distinct_names FROM documents UNION ALL SELECT 'source', 'sourceKey', count(DISTINCT source) FROM documents
""")
def dimension_columns(t):
    return s.dimension_summary(t("documents"), exclude="text")


def _dim(table: str, column: str) -> str:
    return f"SELECT '{column}' AS dimension, cast(row_number() OVER (ORDER BY {column}) AS int) AS key, {column} AS name FROM (SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL)"


@query("build_dimensions", f"{_dim('customer', 'c_name')} UNION ALL {_dim('customer', 'c_mktsegment')}")
def build_dimensions(t):
    return s.build_dimensions(t("customer"))


@query("build_fact", f"""
WITH f AS ({_dim('lineitem', 'l_returnflag')}), g AS ({_dim('lineitem', 'l_linestatus')})
SELECT l.* EXCLUDE (l_returnflag, l_linestatus), f.key AS lreturnflagKey, g.key AS llinestatusKey FROM lineitem l LEFT JOIN f ON f.name = l.l_returnflag LEFT JOIN g ON g.name = l.l_linestatus
""")
def build_fact(t):
    return s.star_schema(t("lineitem")).fact


@query("star_view", "SELECT * FROM orders")
def star_view(t):
    return s.star_schema(t("orders")).view()


_OLD = "(SELECT * FROM customer WHERE c_acctbal < 0)"


@query("incremental_dim_load", f"""
WITH old AS ({_dim(_OLD, 'c_name')}), fresh AS (SELECT cast((SELECT max(key) FROM old) + row_number() OVER (ORDER BY c_name) AS int) AS key, c_name AS name FROM (SELECT DISTINCT c_name FROM customer WHERE c_name NOT IN (SELECT name FROM old))),
names AS (SELECT key, name FROM old UNION ALL SELECT key, name FROM fresh),
olds AS ({_dim(_OLD, 'c_mktsegment')}), freshs AS (SELECT cast((SELECT max(key) FROM olds) + row_number() OVER (ORDER BY c_mktsegment) AS int) AS key, c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT name FROM olds))),
segments AS (SELECT key, name FROM olds UNION ALL SELECT key, name FROM freshs)
SELECT c.c_custkey, n.key AS cnameKey, c.c_nationkey, c.c_acctbal, g.key AS cmktsegmentKey FROM customer c LEFT JOIN names n ON n.name = c.c_name LEFT JOIN segments g ON g.name = c.c_mktsegment
""")
def incremental_dim_load(t):
    old = s.star_schema(t("customer").where("c_acctbal < 0"))
    return s.incremental_dim_load(old, t("customer").where("c_acctbal >= 0")).fact


@query("incremental_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def incremental_round_trip(t):
    old = s.star_schema(t("customer").where("c_acctbal < 0"))
    return s.incremental_dim_load(old, t("customer").where(F.col("c_acctbal") >= 0)).view()
