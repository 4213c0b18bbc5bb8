"""Which elements a store has, and which of them to open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default segmentation, by exact name and then by prefix.
DEFAULT_SEGMENTATIONS = ("table_MOSAIK_proseg", "MOSAIK_proseg", "cell_boundaries", "table_original")

# Tokens of the masks opened at start, and of the mask that is inspected.
STARTUP_TOKENS = ("cellpose", "proseg")
INSPECTOR_TOKENS = ("proseg", "cellpose", "cell")

# Order of statistics in menus.
STATISTIC_ORDER = ("min", "median", "mean", "max", "iqr")

# Each cell-type source with its tables and the masks they annotate.
CELL_TYPE_SOURCES = (
    ("proseg", ("table_MOSAIK_proseg_clustering_squidpy",), ("MOSAIK_proseg",)),
    (
        "proseg_mask",
        ("table_MOSAIK_proseg_mask_clustering_squidpy", "table_MOSAIK_proseg_mask_counts_clustering_squidpy"),
        ("MOSAIK_proseg",),
    ),
    ("cellpose", ("table_MOSAIK_cellpose_clustering_squidpy",), ("MOSAIK_cellpose",)),
    ("original", ("table_original_clustering_squidpy",), ("merscope_cell_boundaries", "cell_boundaries")),
)


def element_catalog(elements: DataFrame) -> DataFrame:
    """Sorted element names per section and family. ``elements(section, family, key)``."""
    names = elements.select("section", "family", "key").distinct()
    return names.groupBy("section", "family").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _best(elements: DataFrame, rank) -> DataFrame:
    ranked = elements.select("section", "key").distinct().withColumn("_rank", rank)
    return ranked.groupBy("section").agg(F.min(F.struct("_rank", "key")).alias("_best")).select(
        "section", F.col("_best._rank").alias("_rank"), F.col("_best.key").alias("key")
    )


def preferred_element(elements: DataFrame) -> DataFrame:
    """Default segmentation per section; else the first name in the alphabet."""
    rank = F.lit(len(DEFAULT_SEGMENTATIONS) * 2)
    for i, name in reversed(list(enumerate(DEFAULT_SEGMENTATIONS))):
        rank = F.when(F.col("key") == name, F.lit(2 * i)).when(
            F.startswith(F.col("key"), F.lit(name + "_")), F.lit(2 * i + 1)).otherwise(rank)
    return _best(elements, rank).drop("_rank")


def startup_segmentations(elements: DataFrame) -> DataFrame:
    """The masks opened at start: per token the exact name, else the first that contains it."""
    out = None
    for token in STARTUP_TOKENS:
        having = elements.filter(F.lower("key").contains(token))
        one = _best(having, F.when(F.col("key") == f"MOSAIK_{token}", F.lit(0)).otherwise(F.lit(1))).drop("_rank")
        out = one if out is None else out.union(one)
    return out.distinct()


def inspected_segmentation(elements: DataFrame) -> DataFrame:
    """The mask whose cells are inspected; else the first one."""
    rank = F.lit(len(INSPECTOR_TOKENS))
    for i, token in reversed(list(enumerate(INSPECTOR_TOKENS))):
        rank = F.when(F.lower("key").contains(token), F.lit(i)).otherwise(rank)
    return _best(elements, rank).drop("_rank")


def source_priorities(spark: SparkSession) -> DataFrame:
    """The fixed table of sources: ``(source, family, key, priority)``."""
    rows = [
        (source, family, key, i)
        for source, tables, masks in CELL_TYPE_SOURCES
        for family, keys in (("tables", tables), ("shapes", masks))
        for i, key in enumerate(keys)
    ]
    return spark.createDataFrame(rows, "source string, family string, key string, priority int")


def resolve_cell_type_source(elements: DataFrame) -> DataFrame:
    """Table and mask of each source per section; null where the section has none of its own."""
    fixed = F.broadcast(source_priorities(elements.sparkSession))  # nine fixed rows
    present = elements.select("section", "family", "key").distinct()
    found = present.join(fixed, ["family", "key"]).groupBy("section", "source").agg(
        F.min_by(F.when(F.col("family") == "tables", F.col("key")), F.when(F.col("family") == "tables", F.col("priority"))).alias("table_key"),
        F.min_by(F.when(F.col("family") == "shapes", F.col("key")), F.when(F.col("family") == "shapes", F.col("priority"))).alias("mask_key"),
    )
    names = F.array(*[F.lit(s[0]) for s in CELL_TYPE_SOURCES])
    every = elements.select("section").distinct().withColumn("source", F.explode(names))
    return every.join(found, ["section", "source"], "left")


def annotation_source(resolved: DataFrame, inspected: DataFrame, selected: str | None = None) -> DataFrame:
    """The source that annotates the inspected mask: the selected one if it does, else the first."""
    masks = F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(m).alias("mask"), F.lit(-1 if s == selected else i).alias("rank"))
        for i, (s, _, ms) in enumerate(CELL_TYPE_SOURCES)
        for m in ms
    ])
    pairs = inspected.select("section", F.col("key").alias("mask"), F.explode(masks).alias("_m")).filter(
        F.col("mask") == F.col("_m.mask")).select("section", F.col("_m.source").alias("source"), F.col("_m.rank").alias("rank"))
    usable = resolved.filter(F.col("table_key").isNotNull()).select("section", "source")
    return pairs.join(usable, ["section", "source"]).groupBy("section").agg(F.min_by("source", "rank").alias("source"))


def quantification_options(features: DataFrame) -> DataFrame:
    """Menu entries: distinct channels by name, then statistics in their usual order."""
    rank = F.lit(len(STATISTIC_ORDER))
    for i, name in reversed(list(enumerate(STATISTIC_ORDER))):
        rank = F.when(F.col("statistic") == name, F.lit(i)).otherwise(rank)
    channels = features.select(F.lit("channel").alias("kind"), F.lit(0).alias("rank"), F.col("channel").alias("name"))
    statistics = features.select(F.lit("statistic").alias("kind"), rank.alias("rank"), F.col("statistic").alias("name"))
    return channels.union(statistics).distinct().orderBy("kind", "rank", "name")


def channel_display_name(channels: DataFrame) -> DataFrame:
    """Channel names, with their image's name where several images have the same channel."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("section", "channel")) <= 1
    name = F.when(alone, F.col("channel")).otherwise(F.concat("image_key", F.lit(": "), "channel"))
    return channels.withColumn("display_name", name)
