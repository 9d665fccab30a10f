"""Queries over the driver tables, jobs and ingest."""

from . import filing_queries, more_queries, queries, table_queries  # noqa: F401  (all but queries add to queries.QUERIES)
