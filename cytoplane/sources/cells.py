"""Cell polygons, images and label rasters as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.operators.cells import TILE, cell_geometry, with_bounds
from cytoplane.operators.tiles import tiles_from_rows


def scan_cells(df: DataFrame, id_column: str = "cell_id", section: str | None = None) -> DataFrame:
    """Cells with text ids, nested parts, bounds and area; empty geometries and ones with a non-finite vertex are dropped.

    Bounds are stored next to the vertices, so that box filters prune on Parquet statistics.
    """
    lead = F.col("section") if section is None else F.lit(section).alias("section")
    extra = [c for c in ("seg_key",) if c in df.columns]
    cells = df.select(
        lead,
        *extra,
        F.col(id_column).cast("string").alias("cell_id"),
        F.col("shape_ord").cast("bigint").alias("shape_ord"),
        F.col("parts").cast(g.PARTS).alias("parts"),
    ).filter(F.size(F.filter("parts", lambda p: F.size(p["exterior"]) >= 3)) > 0)
    cells = cells.filter(F.expr(g.all_finite(f"flatten(transform(parts, fp -> flatten({g.rings_of_part('fp')})))")))
    return cell_geometry(with_bounds(cells)).drop("cx", "cy")


def scan_image_rows(df: DataFrame, key: str, section: str) -> DataFrame:
    """Image rows under canonical names: ``(section, key, channel, row, values, height, width)``.

    ``df`` has one row per (channel, row) with its values as an array, and optionally ``channel``,
    ``z`` and ``channel_index``. A second z plane is an error; an unnamed channel is ``c{i}``; an image
    without channels has the single channel ``c0``.
    """
    if "z" in df.columns:
        planes = df.agg((F.max("z") - F.min("z")).alias("span")).scalar()
        bad = F.raise_error(F.lit("unsupported image with more than one z plane")).cast("bigint")
        df = df.withColumn("row", F.when(planes == 0, F.col("row")).otherwise(bad)).drop("z")
    index = F.col("channel_index") if "channel_index" in df.columns else F.lit(0)
    default = F.concat(F.lit("c"), index.cast("string"))
    channel = F.coalesce(F.col("channel"), default) if "channel" in df.columns else default
    return df.select(
        F.lit(section).alias("section"),
        F.lit(key).alias("key"),
        channel.alias("channel"),
        F.col("row").cast("bigint").alias("row"),
        "values",
        F.col("height").cast("bigint").alias("height"),
        F.size("values").cast("bigint").alias("width"),
    )


def scan_image(df: DataFrame, key: str, section: str) -> DataFrame:
    """Image rows to pixels ``(section, key, channel, row, col, value, height, width)``."""
    rows = scan_image_rows(df, key, section)
    return rows.select("section", "key", "channel", "row", F.posexplode("values").alias("col", "value"), "height", "width").withColumn(
        "col", F.col("col").cast("bigint"))


def scan_image_tiles(df: DataFrame, key: str, section: str, dtype: str, tile: int = TILE) -> DataFrame:
    """Image rows to tiles, without a row per pixel."""
    return tiles_from_rows(scan_image_rows(df, key, section), dtype, tile)


def scan_labels(df: DataFrame, key: str, section: str) -> DataFrame:
    """A label raster as pixels; ids are whole numbers and 0 is background."""
    return scan_image(df, key, section).withColumn("value", F.col("value").cast("bigint"))


def scale_number(name: str) -> tuple[int, int, str]:
    """Order of stored levels: ``scale0``, ``scale1``, … by number, other names after them."""
    digits = name[len(name.rstrip("0123456789")):]
    return (0, int(digits), "") if digits else (1, 0, name)


def write_image_levels(levels: dict[str, DataFrame], path: str) -> None:
    """Store the levels of images as tiles, one folder per section, key and level, and what each level is like.

    ``levels`` maps names to tile tables. Names that begin with ``scale`` are ordered by their number and become levels
    0, 1, … in that order; with none of these, the single table given is level 0. ``levels`` beside the tiles has one
    row per image and level with its size and how many times finer the finest level is, up to rounding.
    """
    scales = sorted((n for n in levels if n.startswith("scale")), key=scale_number) or list(levels)[:1]
    for number, name in enumerate(scales):
        tiles = levels[name].withColumn("level", F.lit(number).cast("bigint"))
        tiles.write.mode("append").partitionBy("section", "key", "level").parquet(f"{path}/tiles")
    spark = next(iter(levels.values())).sparkSession
    stored = spark.read.parquet(f"{path}/tiles")
    sizes = stored.groupBy("section", "key", "level").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    finest = sizes.filter("level = 0").select("section", "key", F.greatest("height", "width").alias("_side"))
    named = F.element_at(F.array(*map(F.lit, scales)), F.col("level").cast("int") + 1)
    sizes.join(finest, ["section", "key"]).select(
        "section", "key", F.col("level").cast("bigint").alias("level"), named.alias("scale"), "height", "width",
        F.round(F.col("_side") / F.greatest("height", "width")).cast("bigint").alias("factor"),
    ).coalesce(1).write.parquet(f"{path}/levels")


def image_levels(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, level, scale, height, width, factor) of stored images."""
    return spark.read.parquet(f"{path}/levels")


def scan_image_level(spark: SparkSession, path: str, section: str, key: str, factor: float = 1.0) -> DataFrame:
    """Tiles of the coarsest level that is not coarser than ``factor`` finest pixels a pixel; the finest if none is.

    The level is chosen from the few rows that describe the image and becomes a partition filter, so nothing of other
    levels is read.
    """
    known = image_levels(spark, path).filter((F.col("section") == section) & (F.col("key") == key)).select("level", "factor").collect()
    if not known:
        raise KeyError(f"no image {key} in section {section}")
    enough = [x.level for x in known if x.factor <= factor]
    level = max(enough) if enough else min(x.level for x in known)
    tiles = spark.read.parquet(f"{path}/tiles")
    return tiles.filter((F.col("section") == section) & (F.col("key") == key) & (F.col("level") == level)).withColumn(
        "level", F.col("level").cast("bigint"))


def drop_derived_elements(catalog: DataFrame, prefix: str) -> DataFrame:
    """Elements that are not private products of this library."""
    return catalog.filter(~F.startswith(F.col("key"), F.lit(prefix)))
