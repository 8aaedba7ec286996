"""Principals, roles and permissions across a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx

# fixed values: principal type codes, the fixed database roles and server roles
TYPE_NAMES = {
    "A": "Application role",
    "C": "User mapped to a certificate",
    "E": "External user from Azure Active Directory",
    "G": "Windows group",
    "K": "User mapped to an asymmetric key",
    "R": "Database role",
    "S": "User (SQL Auth)",
    "U": "User (Windows Auth)",
    "X": "External group from Azure Active Directory group or applications",
}
DATABASE_ROLES = (
    "db_accessadmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_ddladmin",
    "db_denydatareader", "db_denydatawriter", "db_owner", "db_securityadmin",
)
SERVER_ROLES = (
    "bulkadmin", "dbcreator", "diskadmin", "processadmin", "securityadmin", "serveradmin", "setupadmin", "sysadmin",
)
SPECIAL_USERS = ("dbo", "INFORMATION_SCHEMA", "sys")
SKIPPED_MEMBERS = ("dbo", "guest", "INFORMATION_SCHEMA", "public", "sys")
SENSITIVE_ROLES = ("db_accessadmin", "db_backupoperator", "db_securityadmin")


def type_name(code: Column) -> Column:
    """Name of a principal type; NULL for an unknown code."""
    out = F.lit(None).cast("string")
    for key, name in TYPE_NAMES.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def _member_roles(principals: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """Principals left joined to the names of their roles."""
    named = members.join(roles, ["server_name", "role_principal_id"], "left").select(
        "server_name", F.col("member_principal_id").alias("principal_id"), "role_name"
    )
    return principals.join(named, ["server_name", "principal_id"], "left")


def server_role_membership(logins: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """Server principals that are no fixed role, with their roles or an empty name."""
    return _member_roles(logins.where("is_fixed_role = 0"), members, roles).select(
        "server_name", F.col("name").alias("server_principal"), F.col("type_desc").alias("principal_type"),
        F.coalesce("role_name", F.lit("")).alias("server_role"),
    )


def _with_login(principals: DataFrame, logins: DataFrame) -> DataFrame:
    names = logins.select("server_name", "sid", F.col("name").alias("login_name"))
    return principals.join(names, ["server_name", "sid"], "left")


def db_role_membership(principals: DataFrame, members: DataFrame, roles: DataFrame, logins: DataFrame) -> DataFrame:
    """Database users with roles, type name and the server login of the same sid."""
    users = principals.where((F.col("is_fixed_role") == 0) & ~F.col("name").isin(*SPECIAL_USERS))
    return _member_roles(_with_login(users, logins), members, roles).select(
        "server_name", "database_name", F.col("name").alias("database_principal"), type_name(F.col("type")).alias("principal_type"),
        F.coalesce("role_name", F.lit("")).alias("database_role"), F.coalesce("login_name", F.lit("")).alias("server_principal"),
    )


def _permission(missing: str) -> Column:
    return F.coalesce(F.concat("state_desc", F.lit(" "), "permission_name"), F.lit(missing))


def db_principal_permissions(
    principals: DataFrame, permissions: DataFrame, objects: DataFrame, logins: DataFrame
) -> DataFrame:
    """Database principals with explicit permissions and the securable's name."""
    grants = permissions.withColumnRenamed("grantee_principal_id", "principal_id").join(
        objects.withColumnRenamed("object_id", "major_id"), ["server_name", "major_id"], "left"
    )
    return _with_login(principals.where("is_fixed_role = 0"), logins).join(grants, ["server_name", "principal_id"], "left").select(
        "server_name", "database_name", F.col("name").alias("database_principal"), type_name(F.col("type")).alias("principal_type"),
        _permission("no permission statements").alias("permission"), F.coalesce("class_desc", F.lit("")).alias("class_desc"),
        F.coalesce("schema_name", F.lit("")).alias("securable_schema"), F.coalesce("object_name", F.lit("")).alias("securable_object"),
        F.coalesce("login_name", F.lit("")).alias("server_principal"),
    )


def server_principal_permissions(
    logins: DataFrame, permissions: DataFrame, endpoints: DataFrame, fixed_roles: DataFrame
) -> DataFrame:
    """Server principals off the fixed-role list, with permissions and endpoint names.

    ``fixed_roles`` (server_name, name) must not hold NULL names; a NULL there
    would hide every principal of its server, as NOT IN does.
    """
    unknown = fixed_roles.where(F.col("name").isNull()).select("server_name").distinct()
    ends = endpoints.select("server_name", F.col("endpoint_id").alias("major_id"), "protocol_desc")
    grants = permissions.withColumnRenamed("grantee_principal_id", "principal_id").join(ends, ["server_name", "major_id"], "left")
    securable = (
        F.when(F.col("class_desc") == "SERVER_PRINCIPAL", F.lit(None).cast("string"))
        .when(F.col("class_desc") == "ENDPOINT", F.col("protocol_desc"))
        .otherwise(F.lit(""))
    )
    return (
        logins.join(fixed_roles, ["server_name", "name"], "left_anti").join(unknown, "server_name", "left_anti")
        .join(grants, ["server_name", "principal_id"], "left")
        .select(
            "server_name", F.col("name").alias("server_principal"), F.col("type_desc").alias("principal_type"),
            _permission("").alias("permission"), F.coalesce("class_desc", F.lit("")).alias("class_desc"), securable.alias("securable"),
        )
    )


def fixed_role_matrix(role_permissions: DataFrame) -> DataFrame:
    """Permission by role matrix; the deny-reader role is set by hand."""
    denied = "db_denydatareader"
    measured = role_permissions.where(F.col("role_name") != denied).select("server_name", "permission_name", "role_name")
    by_hand = role_permissions.select("server_name").distinct().select(
        "server_name", F.lit("DENY SELECT").alias("permission_name"), F.lit(denied).alias("role_name")
    )
    matrix = measured.unionByName(by_hand).groupBy("server_name", "permission_name").pivot("role_name", list(DATABASE_ROLES)).agg(F.first(F.lit("Y")))
    return matrix.select("server_name", "permission_name", *[F.coalesce(r, F.lit("")).alias(r) for r in DATABASE_ROLES])


def server_role_permission_union(role_permissions: DataFrame) -> DataFrame:
    """Permissions of the eight fixed server roles, tagged by role and sorted."""
    return (
        role_permissions.where(F.col("server_role").isin(*SERVER_ROLES))
        .select("server_name", "server_role", "entity_name", "permission_name").distinct()
        .orderBy("server_name", "server_role", "entity_name", "permission_name")
    )


def orphaned_users(principals: DataFrame, logins: DataFrame) -> DataFrame:
    """Users of instance authentication without a login, with the remap command."""
    users = principals.where((F.col("type_desc") == "SQL_USER") & (F.col("authentication_type_desc") == "INSTANCE"))
    command = F.concat(F.lit("ALTER USER "), tx.quotename("name"), F.lit(" WITH LOGIN = "), tx.quotename("name"), F.lit(";"))
    return users.join(logins.select("server_name", "sid"), ["server_name", "sid"], "left_anti").select(
        "server_name", "database_name", "name", command.alias("command")
    )


def risky_role_members(principals: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """Steps that take members out of sensitive roles and owners down to three roles.

    Report only: one row per member and step.
    """
    rows = _member_roles(principals.where(~F.col("name").isin(*SKIPPED_MEMBERS)), members, roles)
    user = tx.quotename("name")

    def alter(role: str | Column, what: str) -> Column:
        named = F.lit(role) if isinstance(role, str) else role
        return F.concat(F.lit("ALTER ROLE "), tx.quotename(named), F.lit(f" {what} MEMBER "), user)

    def grant(what: str) -> Column:
        return F.concat(F.lit(f"GRANT {what} TO "), user)

    owner_steps = F.array(
        grant("EXECUTE"), grant("CREATE SCHEMA"), grant("VIEW DEFINITION"),
        alter("db_datareader", "ADD"), alter("db_datawriter", "ADD"), alter("db_ddladmin", "ADD"), alter("db_owner", "DROP"),
    )
    steps = F.when(F.col("role_name").isin(*SENSITIVE_ROLES), F.array(alter(F.col("role_name"), "DROP"))).when(
        F.col("role_name") == "db_owner", owner_steps
    )
    return rows.select("server_name", "database_name", F.col("name").alias("user_name"), "role_name", F.posexplode(steps).alias("step", "command"))


def certificate_grants(principals: DataFrame, members: DataFrame, roles: DataFrame, certificates: DataFrame) -> DataFrame:
    """The control grants owners get on every certificate of their database."""
    owners = _member_roles(principals.where(~F.col("name").isin(*SKIPPED_MEMBERS)), members, roles).where("role_name = 'db_owner'")
    command = F.concat(F.lit("GRANT CONTROL ON CERTIFICATE::"), tx.quotename("certificate_name"), F.lit(" TO "), tx.quotename("name"))
    return owners.join(certificates, ["server_name", "database_name"]).select("server_name", "database_name", F.col("name").alias("user_name"), command.alias("command"))


def owner_changes(databases: DataFrame, *, owner: str = "sa") -> DataFrame:
    """Databases that the owner of the server's master database does not own."""
    expected = databases.where("database_name = 'master'").select("server_name", F.col("owner_sid").alias("expected_sid"))
    rows = databases.where(~F.col("database_name").isin("master", "tempdb", "model", "distribution")).join(expected, "server_name")
    command = F.concat(F.lit("ALTER AUTHORIZATION ON DATABASE :: "), tx.quotename("database_name"), F.lit(f" TO [{owner}];"))
    return rows.where(F.col("owner_sid") != F.col("expected_sid")).select("server_name", "database_name", "owner_sid", command.alias("command"))
