"""All registered queries and their oracle statements."""

from prismtally.queries import (  # noqa: F401
    insights,
    joining,
    measuring,
    profiling,
    refreshing,
    rows,
    sources,
    workbench,
)
from prismtally.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
