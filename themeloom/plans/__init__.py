"""Registered queries with their SQL."""

from themeloom.plans import crosstabs, extra, facts, forest, modelling, relational, texts  # noqa: F401
from themeloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
