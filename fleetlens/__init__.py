"""Spark operators for database-fleet observability.

Telemetry and catalog snapshots of many servers come in as DataFrames (batch or
streaming); reports, violations, alert rows and command text come out as
DataFrames.  Nothing here acts on a server.
"""
