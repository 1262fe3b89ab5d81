"""All registered queries and their SQL."""

from . import catalog, catalog_io, catalog_state  # noqa: F401

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
