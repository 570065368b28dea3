"""All queries by name, and the SQL of those that SQL expresses."""

from . import evaluation, further, intake, live, more, series, study  # noqa: F401  they register themselves
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
