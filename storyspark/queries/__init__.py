"""Registered queries and their SQL twins."""

from storyspark.queries import beats, intervals, jobs, search, sources, text  # noqa: F401
from storyspark.queries.registry import QUERIES, SQL  # noqa: F401
