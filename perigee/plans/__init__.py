"""All queries over the driver's tables, by name, with the SQL that must agree."""

from perigee.plans import path_queries, record_queries, sky_queries, store_queries  # noqa: F401  (they register theirs)
from perigee.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
