"""Registered queries: each one runs an operator over the given tables, most with a DuckDB twin."""

from .registry import QUERIES, oracle_sql, queries, survey_ids  # noqa: F401
from . import scalars, text, pages, annotations, forms, recents, streams, workflows  # noqa: F401,E402
