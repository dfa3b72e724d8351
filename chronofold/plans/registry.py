"""Query registry: name -> Spark plan, and for most of them the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def bind(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, directory: plan(Tables(spark, directory))


def r(c: str | Column, places: int = 6) -> Column:
    """Rounded double under its own name; adding 0.0 folds a negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    rounded = F.round(column, places) + F.lit(0.0)
    return rounded.alias(c) if isinstance(c, str) else rounded
