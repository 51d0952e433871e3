"""Registered queries of the place engine, by name, and their oracle SQL."""

from placeweave.queries import ingesting, places, planning, scores, texts

MODULES = (scores, places, texts, planning, ingesting)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
