"""Where the query modules of this package put their entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tally.llm.common import small_arrow
from tally.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its twin, where SQL can express it."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(small_arrow(tune(spark)), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
