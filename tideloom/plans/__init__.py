"""Registered queries. Importing this package registers all of them."""

from tideloom.plans import features, forecasting, preparation, scoring, windows  # noqa: F401
from tideloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
