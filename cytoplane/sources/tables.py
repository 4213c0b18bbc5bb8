"""Per-cell and per-gene tables: quantification, clustering labels, marker reference, transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import affine
from cytoplane.functions.text import split_neurons, strip
from cytoplane.operators.celltypes import drop_missing_labels

# Names of the id column of a clustering table.
INSTANCE_NAMES = ("cell", "cell_id", "cells", "cell_ID", "EntityID", "label_id")

# Pixel sizes in microns where a section has no transform of its own.
FALLBACK_PIXEL_SIZE = {"MERSCOPE": 0.108, "XENIUM": 0.2125}


def feature_columns(var: DataFrame) -> DataFrame:
    """Feature metadata with the default name ``image__channel__statistic``."""
    default = F.concat_ws("__", "image_key", "channel", "statistic")
    name = F.coalesce("feature", default) if "feature" in var.columns else default
    return var.select(
        name.alias("feature"), "image_key", "channel", "statistic", F.col("column_index").cast("bigint").alias("column_index")
    )


def scan_quantification(obs: DataFrame, var: DataFrame) -> DataFrame:
    """Wide rows ``(label_id, values array)`` to long values with their feature.

    A row with more or fewer values than there are features is an error. The feature table has one row
    per matrix column and joins on its index.
    """
    features = feature_columns(var)
    width = features.agg(F.count(F.lit(1)).cast("int")).scalar()
    checked = F.when(F.size("values") == width, F.col("values")).otherwise(
        F.raise_error(F.lit("quantification row and feature metadata differ in length")).cast("array<double>")
    )
    long = obs.select(F.col("label_id").cast("bigint").alias("label_id"), F.posexplode(checked).alias("column_index", "value"))
    return long.withColumn("column_index", F.col("column_index").cast("bigint")).join(features, "column_index")


def instance_column(columns: list[str], declared: str | None = None) -> str | None:
    """The id column of a clustering table: as declared, else by its usual names."""
    if declared in columns:
        return declared
    return next((name for name in INSTANCE_NAMES if name in columns), None)


def scan_cell_types(df: DataFrame, declared: str | None = None, index_column: str | None = None) -> DataFrame:
    """Per-cell labels ``(cell_id bigint, broad, fine)``: neurons split, missing labels dropped."""
    id_name = instance_column(df.columns, declared) or index_column
    if id_name is None or "broad_class" not in df.columns:
        raise ValueError("a clustering table needs broad_class and an id column")
    text = strip(F.col(id_name).cast("string"))
    number = F.coalesce(text.try_cast("bigint"), F.when(
        text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double").try_cast("bigint")))
    broad = strip("broad_class")
    if "neuron_split_label" in df.columns:
        broad = split_neurons("broad_class", F.coalesce("neuron_split_label", F.lit("")))
    fine = strip("hierarchical_cluster") if "hierarchical_cluster" in df.columns else broad
    return drop_missing_labels(df.select(number.alias("cell_id"), broad.alias("broad"), fine.alias("fine")))


def _reference_rows(entries: DataFrame, keep: list[str]) -> DataFrame:
    return entries.filter(F.col("broad").isNotNull()).select(*keep, "gene", "broad", F.coalesce("fine", F.lit("")).alias("fine"))


def scan_marker_reference(texts: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Marker reference from JSON text, one document per row.

    ``keep`` names columns of ``texts`` that stay; then ``_ord`` tells each entry's place in its text.

    Takes ``{gene: {broad, fine}}``, the same under ``genes``, long key names, and ``[broad, fine]`` pairs.
    Text that is not JSON gives no rows.
    """
    outer = F.from_json(F.col(column), "map<string,string>")
    body = F.when(F.map_contains_key(outer, "genes"), F.from_json(outer["genes"], "map<string,string>")).otherwise(outer)
    kept = list(keep or [])
    each = texts.select(*kept, F.posexplode(body).alias("_ord", "gene", "info")).withColumn("_ord", F.col("_ord").cast("bigint"))
    kept += ["_ord"] if keep else []
    named = F.from_json("info", "struct<broad:string,fine:string,broad_cell_type:string,fine_cell_type:string>")
    pair = F.from_json("info", "array<string>")
    is_pair = F.startswith(F.ltrim("info"), F.lit("["))

    def alias(short: str, long: str):
        # An empty value falls through to the longer name.
        return F.coalesce(F.when(named[short] != "", named[short]), named[long])

    return _reference_rows(each.select(
        *kept,
        "gene",
        F.when(is_pair, F.get(pair, 0)).otherwise(alias("broad", "broad_cell_type")).alias("broad"),
        F.when(is_pair, F.get(pair, 1)).otherwise(alias("fine", "fine_cell_type")).alias("fine"),
        (is_pair & (F.size(pair) < 2)).alias("_short"),
    ).filter(~F.col("_short")), kept)


def marker_reference_from_columns(var: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Marker reference from ``gene, broad_cell_type[, fine_cell_type]`` columns; columns in ``keep`` stay."""
    broad = strip("broad_cell_type")
    fine = F.coalesce("fine_cell_type", F.lit("")) if "fine_cell_type" in var.columns else F.lit("")
    return var.filter(broad.isNotNull() & ~F.lower(broad).isin("", "nan", "none")).select(
        *(keep or []), "gene", broad.alias("broad"), F.when(F.lower(fine).isin("nan", "none"), F.lit("")).otherwise(fine).alias("fine")
    )


def resolve_marker_reference(texts: DataFrame, var: DataFrame, column: str = "text") -> DataFrame:
    """The marker reference of each section (section, gene, broad, fine), one row per gene.

    The JSON text of a section counts, if it gives any row; else its columns ``gene, broad_cell_type[, fine_cell_type]``; else
    the section has none. Of several entries for a gene the last one counts: by the order of the text, or by
    ``var_ord`` of the columns where there is one (else the greatest types).
    """
    order = F.col("var_ord") if "var_ord" in var.columns else F.lit(0)
    by_text = scan_marker_reference(texts, column, ["section"]).withColumn("_from", F.lit(0))
    by_column = marker_reference_from_columns(var.withColumn("_ord", order.cast("bigint")), ["section", "_ord"]).withColumn("_from", F.lit(1))
    entries = by_text.unionByName(by_column)
    last = entries.groupBy("section", "_from", "gene").agg(F.max(F.struct("_ord", "broad", "fine")).alias("_e"))
    first = entries.groupBy("section").agg(F.min("_from").alias("_from"))
    return last.join(first, ["section", "_from"]).select("section", "gene", "_e.broad", "_e.fine")


def transforms_from_matrix(texts: DataFrame) -> DataFrame:
    """Transforms from micron-to-pixel matrices ``(section, text)``: nine numbers, which are inverted."""
    n = F.transform(F.split(strip("text"), r"\s+"), lambda v: v.cast("double"))
    matrix = texts.withColumn("_n", n).select("section", *[F.element_at("_n", i + 1).alias(k) for i, k in enumerate(affine.NAMES)])
    return matrix.select("section", *[c.alias(k) for k, c in affine.invert(affine.columns()).items()])


def transforms_from_spec(texts: DataFrame) -> DataFrame:
    """Transforms from JSON documents ``(section, text)`` with ``pixel_size``, or its usual value."""
    stored = F.get_json_object("text", "$.pixel_size").try_cast("double")
    size, zero = F.coalesce(stored, F.lit(FALLBACK_PIXEL_SIZE["XENIUM"])), F.lit(0.0)
    return texts.select(
        "section", size.alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d"), size.alias("e"), zero.alias("f")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def scan_pixel_transform(spark: SparkSession, section: str, path: str | None = None) -> DataFrame:
    """The one-row pixel-to-micron transform of a section.

    MERSCOPE stores the micron-to-pixel matrix as text, which is inverted; XENIUM a JSON file with
    ``pixel_size``. Without a path, or where nothing is there, both fall back to their usual pixel size.
    """
    name = section.upper()
    if name not in FALLBACK_PIXEL_SIZE:
        raise ValueError(f"unknown section kind: {section}")
    if path is None or not _exists(spark, path):
        size = FALLBACK_PIXEL_SIZE[name]
        fixed = affine.literal(a=size, e=size)
        return spark.range(1).select(F.lit(name).alias("section"), *[c.alias(k) for k, c in fixed.items()])
    text = spark.read.text(path, wholetext=True).select(F.lit(name).alias("section"), F.col("value").alias("text"))
    return transforms_from_matrix(text) if name == "MERSCOPE" else transforms_from_spec(text)
