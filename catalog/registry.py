"""Where the query modules put their entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.fixtures import frame, with_inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register ``fn(*frames)`` under ``name``; ``sql`` is its twin over the same inputs."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[frame(spark, sf_dir, i) for i in inputs])
        if sql is not None:
            derived = [i for i in inputs if i.startswith("D_")]
            ORACLES[name] = with_inputs(sql, *derived) if derived else sql
        return fn

    return add
