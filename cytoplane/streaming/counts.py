"""Structured Streaming over transcript files.

There is no event time in a transcript table, so counts keep one state row per gene, or per (cell, gene)
pair, for as long as the query lives. State is hash-partitioned by the whole key and pre-aggregated before
its shuffle. Where the pairs outgrow a state store, :func:`merge_cell_gene_counts` keeps the totals in a
table instead and only ever holds one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cytoplane.operators import transcripts as t
from cytoplane.sources.transcripts import canonical_transcripts


def read_arriving(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_gene_counts(stream: DataFrame) -> DataFrame:
    """Running counts per gene."""
    return t.gene_counts(stream)


def stream_cell_gene_counts(stream: DataFrame, exact: bool = True) -> DataFrame:
    """Running counts per (cell, gene)."""
    return t.cell_gene_counts(stream, exact)


def ingested(stream: DataFrame, section: str | None = None) -> DataFrame:
    """Canonical, valid, flagged points of a raw stream; stateless."""
    return t.with_background(t.valid_points(canonical_transcripts(stream, section)))


def stream_ingest(stream: DataFrame, path: str, checkpoint: str, section: str | None = None) -> StreamingQuery:
    """Append what has arrived to the transcript table, each file once."""
    return (
        ingested(stream, section)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batches(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the complete running counts after each batch as the table ``path``."""
    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def merge_cell_gene_counts(stream: DataFrame, path: str, checkpoint: str, exact: bool = True) -> StreamingQuery:
    """Append one partial count per batch, keyed by batch; totals are the sum over batches.

    A batch that runs again replaces its own partition, so a retry counts nothing twice, and no state
    is kept between batches. Read with :func:`merged_totals`.
    """
    def append(batch: DataFrame, epoch: int) -> None:
        part = t.cell_gene_counts(batch, exact)
        part.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
    )


def merged_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("cell_id", "gene").agg(F.sum("n").alias("n"))
