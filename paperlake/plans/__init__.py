"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from paperlake.plans import knowledge, layout, lifecycle, retrieval, writing  # noqa: F401
from paperlake.plans.tables import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
