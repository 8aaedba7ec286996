"""Security family."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import security as s
from fleetlens.plans.registry import query


def _type_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.TYPE_NAMES.items()) + " END"


_ROLES = """LEFT JOIN (SELECT m.server_name, m.member_principal_id, r.role_name FROM fx_role_member m LEFT JOIN fx_role r ON r.server_name = m.server_name AND r.role_principal_id = m.role_principal_id) mr
  ON mr.server_name = p.server_name AND mr.member_principal_id = p.principal_id"""
_LOGIN = "LEFT JOIN fx_server_login l ON l.server_name = p.server_name AND l.sid = p.sid"


@query("server_role_membership", f"SELECT p.server_name, p.name AS server_principal, p.type_desc AS principal_type, coalesce(mr.role_name, '') AS server_role FROM fx_server_login p {_ROLES} WHERE p.is_fixed_role = 0")
def server_role_membership(t):
    return s.server_role_membership(t("fx_server_login"), t("fx_role_member"), t("fx_role"))


@query("db_role_membership", f"""
SELECT p.server_name, p.database_name, p.name AS database_principal, {_type_sql('p.type')} AS principal_type, coalesce(mr.role_name, '') AS database_role, coalesce(l.name, '') AS server_principal
FROM fx_principal p {_ROLES} {_LOGIN} WHERE p.is_fixed_role = 0 AND p.name NOT IN ('dbo', 'INFORMATION_SCHEMA', 'sys')
""")
def db_role_membership(t):
    return s.db_role_membership(t("fx_principal"), t("fx_role_member"), t("fx_role"), t("fx_server_login"))


@query("db_principal_permissions", f"""
SELECT p.server_name, p.database_name, p.name AS database_principal, {_type_sql('p.type')} AS principal_type, coalesce(g.state_desc || ' ' || g.permission_name, 'no permission statements') AS permission, coalesce(g.class_desc, '') AS class_desc,
  coalesce(o.schema_name, '') AS securable_schema, coalesce(o.object_name, '') AS securable_object, coalesce(l.name, '') AS server_principal
FROM fx_principal p LEFT JOIN fx_permission g ON g.server_name = p.server_name AND g.grantee_principal_id = p.principal_id LEFT JOIN fx_object_name o ON o.server_name = g.server_name AND o.object_id = g.major_id {_LOGIN} WHERE p.is_fixed_role = 0
""")
def db_principal_permissions(t):
    return s.db_principal_permissions(t("fx_principal"), t("fx_permission"), t("fx_object_name"), t("fx_server_login"))


@query("server_principal_permissions", """
SELECT p.server_name, p.name AS server_principal, p.type_desc AS principal_type, coalesce(g.state_desc || ' ' || g.permission_name, '') AS permission, coalesce(g.class_desc, '') AS class_desc,
  CASE WHEN g.class_desc = 'SERVER_PRINCIPAL' THEN NULL WHEN g.class_desc = 'ENDPOINT' THEN (SELECT e.protocol_desc FROM fx_endpoint e WHERE e.server_name = g.server_name AND e.endpoint_id = g.major_id) ELSE '' END AS securable
FROM fx_server_login p LEFT JOIN fx_permission g ON g.server_name = p.server_name AND g.grantee_principal_id = p.principal_id
WHERE p.name NOT IN (SELECT f.name FROM fx_server_login f WHERE f.is_fixed_role = 1 AND f.server_name = p.server_name)
""")
def server_principal_permissions(t):
    fixed = t("fx_server_login").where("is_fixed_role = 1").select("server_name", "name")
    return s.server_principal_permissions(t("fx_server_login"), t("fx_permission"), t("fx_endpoint"), fixed)


_MATRIX = ", ".join(f"CASE WHEN bool_or(role_name = '{r}') THEN 'Y' ELSE '' END AS {r}" for r in s.DATABASE_ROLES)


@query("fixed_role_matrix", f"""
SELECT server_name, permission_name, {_MATRIX} FROM (SELECT server_name, permission_name, role_name FROM fx_role_permission WHERE role_name <> 'db_denydatareader' UNION ALL SELECT DISTINCT server_name, 'DENY SELECT', 'db_denydatareader' FROM fx_role_permission) GROUP BY 1, 2
""")
def fixed_role_matrix(t):
    return s.fixed_role_matrix(t("fx_role_permission"))


@query("server_role_permission_union", "SELECT DISTINCT server_name, server_role, entity_name, permission_name FROM fx_role_permission")
def server_role_permission_union(t):
    return s.server_role_permission_union(t("fx_role_permission"))


@query("orphaned_users", """
SELECT p.server_name, p.database_name, p.name, 'ALTER USER [' || p.name || '] WITH LOGIN = [' || p.name || '];' AS command FROM fx_principal p
WHERE p.type_desc = 'SQL_USER' AND p.authentication_type_desc = 'INSTANCE' AND NOT EXISTS (SELECT 1 FROM fx_server_login l WHERE l.server_name = p.server_name AND l.sid = p.sid)
""")
def orphaned_users(t):
    return s.orphaned_users(t("fx_principal"), t("fx_server_login"))


_MEMBERS = f"""rm AS (SELECT p.server_name, p.database_name, p.name AS user_name, mr.role_name FROM fx_principal p {_ROLES} WHERE p.name NOT IN ('dbo', 'guest', 'INFORMATION_SCHEMA', 'public', 'sys'))"""


@query("risky_role_members", f"""
WITH {_MEMBERS},
steps AS (SELECT *, 0 AS step, 'ALTER ROLE [' || role_name || '] DROP MEMBER [' || user_name || ']' AS command FROM rm WHERE role_name IN ('db_accessadmin', 'db_backupoperator', 'db_securityadmin')
  UNION ALL SELECT rm.*, v.step, replace(v.command, '?', '[' || user_name || ']') FROM rm, (VALUES (0, 'GRANT EXECUTE TO ?'), (1, 'GRANT CREATE SCHEMA TO ?'), (2, 'GRANT VIEW DEFINITION TO ?'), (3, 'ALTER ROLE [db_datareader] ADD MEMBER ?'),
    (4, 'ALTER ROLE [db_datawriter] ADD MEMBER ?'), (5, 'ALTER ROLE [db_ddladmin] ADD MEMBER ?'), (6, 'ALTER ROLE [db_owner] DROP MEMBER ?')) v(step, command) WHERE role_name = 'db_owner')
SELECT * FROM steps
""")
def risky_role_members(t):
    return s.risky_role_members(t("fx_principal"), t("fx_role_member"), t("fx_role"))


@query("certificate_grants", f"""
WITH {_MEMBERS}, certs AS (SELECT DISTINCT server_name, database_name, 'cert_' || database_name AS certificate_name FROM fx_fragmentation)
SELECT rm.server_name, rm.database_name, rm.user_name, 'GRANT CONTROL ON CERTIFICATE::[' || c.certificate_name || '] TO [' || rm.user_name || ']' AS command FROM rm JOIN certs c ON c.server_name = rm.server_name AND c.database_name = rm.database_name WHERE rm.role_name = 'db_owner'
""")
def certificate_grants(t):
    certs = t("fx_fragmentation").select("server_name", "database_name", F.concat(F.lit("cert_"), "database_name").alias("certificate_name")).distinct()
    return s.certificate_grants(t("fx_principal"), t("fx_role_member"), t("fx_role"), certs)


@query("owner_changes", """
SELECT d.server_name, d.database_name, d.owner_sid, 'ALTER AUTHORIZATION ON DATABASE :: [' || d.database_name || '] TO [sa];' AS command FROM fx_databases d JOIN fx_databases m ON m.server_name = d.server_name AND m.database_name = 'master'
WHERE d.database_name NOT IN ('master', 'tempdb', 'model', 'distribution') AND d.owner_sid <> m.owner_sid
""")
def owner_changes(t):
    return s.owner_changes(t("fx_databases"))
