"""All registered queries and their oracles."""

from leadloom.plans import catalog_discovery, catalog_scoring, catalog_search, catalog_store  # noqa: F401
from leadloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
