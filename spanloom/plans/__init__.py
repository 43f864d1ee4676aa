"""Registered queries over the driver tables, each beside its SQL twin."""

from spanloom.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
