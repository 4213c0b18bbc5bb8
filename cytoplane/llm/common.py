"""Shared pieces: reading tables, hold-out folds, bounded memos, hot-safe lookups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.plans.registry import scratch

#: Entries a worker's memo may hold before it starts anew; it only saves work, results never depend on it.
MEMO_ENTRIES = 400_000
#: Separators which str.split() takes for white space and Unicode does not.
_INFORMATION_SEPARATORS = re.compile("[\x1c-\x1f]")
_UNICODE_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def chunks(text: str) -> list[str]:
    """The text between runs of Unicode white space."""
    if _INFORMATION_SEPARATORS.search(text):
        return [x for x in _UNICODE_SPACE.split(text) if x]
    return text.split()


class Memo(dict):
    """``memo[key]`` computes what is missing. ``trim()`` between batches bounds it: what was not used since the last
    turn but one is forgotten."""

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def missing(self, keys: set) -> list:
        """Those of the keys whose values are in neither turn; values of the last turn are taken over."""
        keys = keys - self.keys()
        again = keys & self.old.keys()
        self.update((k, self.old[k]) for k in again)
        return list(keys - again)

    def trim(self) -> None:
        if len(self) > self.entries // 2:
            self.old = dict(self)
            self.clear()


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about ``chars`` bytes of text each (at least one row), with their texts; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
        part = batch.slice(at, to - at)
        yield part, [x or "" for x in part.column(column).to_pylist()]
        at = to


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a compressed table next to the checkpoints."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Tables between the steps of a job, each deleted once what was made of it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here remove their shuffle files when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def offsets_of(counts) -> np.ndarray:
    """Start of each group in the concatenation of groups of these sizes, and the total at the end."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups along the first axis; empty groups give 0."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return run[offsets[1:]] - run[offsets[:-1]]
