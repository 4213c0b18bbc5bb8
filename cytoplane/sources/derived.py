"""Derived tables that are built once and reused while their parameters match."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_META = "_derived_meta"


class ForeignElement(RuntimeError):
    """The path holds data that this library did not write."""


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _recorded(spark: SparkSession, path: str) -> dict | None:
    meta = _read(spark, f"{path}/{_META}")
    rows = [] if meta is None else meta.limit(1).collect()
    return None if not rows else {**json.loads(rows[0]["parameters"]), "version": rows[0]["version"], "complete": rows[0]["complete"]}


def _record(spark: SparkSession, path: str, parameters: dict, complete: bool) -> None:
    row = spark.range(1).select(
        F.lit(VERSION).alias("version"), F.lit(complete).alias("complete"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters")
    )
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_META}")


def is_complete(spark: SparkSession, path: str, parameters: dict) -> bool:
    """Whether a finished table of this version with all these parameters is stored."""
    have = _recorded(spark, path)
    if not have or not have["complete"] or have["version"] != VERSION:
        return False
    return all(have.get(name) == value for name, value in json.loads(json.dumps(parameters)).items())


def materialize_derived(
    spark: SparkSession,
    path: str,
    parameters: dict,
    build: Callable[[], DataFrame],
    overwrite: bool = False,
) -> DataFrame:
    """Read the stored table if it is complete and matches; otherwise build and store it.

    The record says "incomplete" until the data is written, so a job that dies halfway is rebuilt. A
    path with data but without our record is never touched.
    """
    if not overwrite and is_complete(spark, path, parameters):
        return spark.read.parquet(f"{path}/data")
    if _recorded(spark, path) is None and (_read(spark, path) is not None or _read(spark, f"{path}/data") is not None):
        raise ForeignElement(f"refusing to replace data that is not a derived table: {path}")
    _record(spark, path, parameters, complete=False)
    build().write.mode("overwrite").parquet(f"{path}/data")
    _record(spark, path, parameters, complete=True)
    return spark.read.parquet(f"{path}/data")
