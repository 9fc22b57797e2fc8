"""Registered queries and the SQL that gives the same rows."""

from quillspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
