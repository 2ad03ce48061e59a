"""Queries over the driver tables; importing the modules fills the registry."""

from tidemark.functions.registry import QUERIES, SQL
from tidemark.plans import bars, factors, features, joins, ledgers, metrics, projections, research, sources, splits, streams  # noqa: F401

__all__ = ["QUERIES", "SQL"]
