"""Registered queries on the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from . import document_queries, geometry_queries, layer_queries, panel_queries, report_queries, validation_queries

QUERIES = panel_queries.QUERIES | layer_queries.QUERIES | report_queries.QUERIES | geometry_queries.QUERIES | document_queries.QUERIES | validation_queries.QUERIES
ORACLE_SQL = panel_queries.ORACLE_SQL | layer_queries.ORACLE_SQL | report_queries.ORACLE_SQL | geometry_queries.ORACLE_SQL | document_queries.ORACLE_SQL | validation_queries.ORACLE_SQL
