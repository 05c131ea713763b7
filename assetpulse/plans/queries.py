"""All registered queries."""

from . import catalog, etl_queries, list_queries, spatial_queries  # noqa: F401

QUERIES = catalog.QUERIES
