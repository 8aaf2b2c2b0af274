"""Registered queries over the supplied tables."""

from folioquery.plans import assessment, retrieval, services, structure  # noqa: F401
from folioquery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
