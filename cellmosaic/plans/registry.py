"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.plans.inputs import Inputs
from cellmosaic.plans.oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of :class:`Inputs` under its own name."""

    def register(fn: Callable[[Inputs], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists already")
        QUERIES[key] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle:
            ORACLES[key] = sql(oracle)
        return fn

    return register


def r6(value: Column, digits: int = 6) -> Column:
    """Rounded value without negative zero."""
    return F.round(value, digits) + F.lit(0.0)
