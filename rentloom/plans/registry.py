"""All registered queries of the rental part, with their DuckDB counterparts."""

from __future__ import annotations

from rentloom.plans import queries_files, queries_pipelines, queries_relational, queries_scalar

QUERIES: dict = queries_scalar.QUERIES | queries_relational.QUERIES | queries_pipelines.QUERIES | queries_files.QUERIES
ORACLE: dict = queries_scalar.ORACLE | queries_relational.ORACLE | queries_pipelines.ORACLE | queries_files.ORACLE
