"""All queries of the engine."""

from quillon.plans import corpus, indexing, points, reports, retrieval, service, sessions, streams  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
