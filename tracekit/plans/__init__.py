"""Queries over the given tables, with their SQL. Each module registers its own."""

from tracekit.plans import behaviour, cohort, extended, images, models, more, places, signals, whole  # noqa: F401
from tracekit.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
