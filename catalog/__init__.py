"""Queries over the given tables, with the SQL that checks them."""

from catalog.base import ORACLES, QUERIES
from catalog import (  # noqa: F401  (each registers its queries)
    adapters,
    chunks,
    labels,
    scaling,
    streams,
    tasks,
    training,
    walkforward,
)

__all__ = ["ORACLES", "QUERIES"]
