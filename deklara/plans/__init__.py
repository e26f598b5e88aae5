"""Registered queries: each applies the operators to the given tables."""

from deklara.plans import catalogs, files, keys, views  # noqa: F401
from deklara.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
