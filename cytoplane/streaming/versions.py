"""Running totals as a table of versions.

Each batch writes only the totals that it changed, as a delta of its own. A small manifest names the base and the deltas
that make up a version; it is written beside the others and renamed into place, so a reader sees the version before or
the one after, never a part. After some deltas a batch also merges them into a new base. Manifests and folders that no
recent version needs are removed. A batch that runs again finds its version published, or replaces its own unfinished
folders.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Deltas after which they are merged, and versions whose folders are kept for readers that have begun.
MERGE_AFTER = 8
KEEP = 4


class Versions:
    """The manifests under ``path``; any file system that Spark can write to, by its own interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        place = self._place("manifests")
        if not self.fs.exists(place):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in self.fs.listStatus(place) if x.getPath().getName().endswith(".json"))

    def read(self, number: int) -> dict:
        # Python reads it whole: a manifest is a few names.
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def current(self) -> dict | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def publish(self, manifest: dict) -> None:
        """Make a version visible; renaming does not replace one that is there."""
        hidden = self._place(f"manifests/_{uuid4().hex}")
        out = self.fs.create(hidden)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(hidden, self._place(f"manifests/{manifest['version']:012d}.json")):
            self.fs.delete(hidden, False)

    def clean(self) -> None:
        """Remove manifests before the last few, and folders that no manifest left names."""
        numbers = self.numbers()
        for number in numbers[:-KEEP]:
            self.fs.delete(self._place(f"manifests/{number:012d}.json"), False)
        named = {x for n in numbers[-KEEP:] for m in [self.read(n)] for x in [m["base"], *m["deltas"]]}
        newest = max(numbers)
        for kind in ("base", "delta"):
            if self.fs.exists(self._place(kind)):
                for x in self.fs.listStatus(self._place(kind)):
                    name = x.getPath().getName()
                    if f"{kind}/{name}" not in named and int(name) <= newest:
                        self.fs.delete(x.getPath(), True)

    def table(self, manifest: dict) -> DataFrame:
        """The rows of a version: of each key the latest total."""
        schema = T.StructType.fromJson(manifest["schema"])
        parts = [x for x in [manifest["base"], *manifest["deltas"]] if x]
        rows = self.spark.createDataFrame([], schema).withColumn("_version", F.lit(-1))
        for part in parts:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            rows = rows.unionByName(one.withColumn("_version", F.lit(int(part.split("/")[1]))))
        if len(parts) == 1:
            return rows.drop("_version")
        latest = [F.max_by(c, "_version").alias(c) for c in schema.names if c not in manifest["key"]]
        return rows.groupBy(*manifest["key"]).agg(*latest).select(*schema.names)


def write_versions(counts: DataFrame, key: list[str], path: str, checkpoint: str, merge_after: int = MERGE_AFTER) -> StreamingQuery:
    """Publish a version of running ``counts`` after each batch; ``key`` tells their rows apart.

    The stream is run in update mode, so a batch hands over only the rows that it changed, with their new totals.
    """
    spark = counts.sparkSession
    versions = Versions(spark, path)
    if versions.current() is None:
        # From here on there is a table, if an empty one.
        versions.publish({"version": 0, "epoch": -1, "key": key, "schema": counts.schema.jsonValue(), "base": None, "deltas": []})

    def publish(batch: DataFrame, epoch: int) -> None:
        now = versions.current()
        if epoch <= now["epoch"]:
            return
        number = now["version"] + 1
        delta = f"delta/{number:012d}"
        batch.write.mode("overwrite").parquet(f"{path}/{delta}")
        new = now | {"version": number, "epoch": epoch, "deltas": [*now["deltas"], delta]}
        if len(new["deltas"]) >= merge_after:
            base = f"base/{number:012d}"
            versions.table(new).write.mode("overwrite").parquet(f"{path}/{base}")
            new |= {"base": base, "deltas": []}
        versions.publish(new)
        versions.clean()

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version. It is one fixed set of files, whatever is published while it is read."""
    versions = Versions(spark, path)
    return versions.table(versions.current())
