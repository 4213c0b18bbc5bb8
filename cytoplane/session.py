"""Session helpers: where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for checkpoints: the one the cluster names, or a scratch one for a local master.

    A cluster without ``spark.checkpoint.dir`` is an error, because a machine-local folder would
    lose the blocks of a lost executor.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-cytoplane-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so later steps see one fixed set of rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
