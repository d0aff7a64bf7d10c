"""Named queries over the given tables, each with the SQL that checks it."""

from edgetables.registry import components, edges, graphs, io, ordered, runs  # noqa: F401
from edgetables.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
