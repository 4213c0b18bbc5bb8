"""Names of queries, with their Spark plan and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from cytoplane.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, or under the operator's name where that is taken."""
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/cytoplane-{name}-{uuid4().hex}"
