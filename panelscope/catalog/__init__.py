"""The operators as queries over the test tables, each with an equivalent SQL text."""

from panelscope.catalog import cleaning, comparison, marts, streams, tables
from panelscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
