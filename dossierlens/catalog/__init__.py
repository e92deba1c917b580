"""All registered queries and their check statements."""

from dossierlens.catalog import lookups, recognition, scalars, sql_rules, streams, tables, understanding  # noqa: F401  (they register)
from dossierlens.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
