"""Queries over the standard tables, and SQL for them."""

from . import pages  # noqa: F401  registers its queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
