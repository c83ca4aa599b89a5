"""Registry of queries over the test tables and helpers to make results comparable across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL text where SQL can express it."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded, because sums depend on the order of the rows in the last digits."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def listed(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})
