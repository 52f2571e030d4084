"""All registered queries."""

from exselect.plans import queries_analytics, queries_influence, queries_selection, queries_text  # noqa: F401
from exselect.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
