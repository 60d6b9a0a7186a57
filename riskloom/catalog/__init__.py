"""Queries by name, over the test tables, and the SQL that checks them."""

from riskloom.catalog import atm, churn, fraud, models, registry, scores  # noqa: F401
from riskloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
