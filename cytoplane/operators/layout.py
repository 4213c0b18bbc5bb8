"""Physical layouts that let a scan skip what it does not need, and look-ups that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions.text import normalize_cell_key
from cytoplane.operators.transcripts import cell_key, cell_transcripts

#: Bits of each coordinate in a Hilbert key.
BITS = 16


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place of a point along the Hilbert curve; ``x`` and ``y`` are whole numbers below ``2**bits``."""
    side = (1 << bits) - 1

    def step(state: Column, at: Column) -> Column:
        x, y = state["x"], state["y"]
        right, up = F.call_function("shiftright", x, at).bitwiseAND(F.lit(1)), F.call_function("shiftright", y, at).bitwiseAND(F.lit(1))
        quarter = (F.lit(3) * right).bitwiseXOR(up)
        # In the lower quarters the curve is turned, on the right also mirrored.
        mirror = (up == 0) & (right == 1)
        mx, my = F.when(mirror, side - x).otherwise(x), F.when(mirror, side - y).otherwise(y)
        return F.struct(
            F.when(up == 0, my).otherwise(mx).alias("x"), F.when(up == 0, mx).otherwise(my).alias("y"),
            (state["d"] * 4 + quarter).alias("d"))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def hilbert_layout(cells: DataFrame) -> DataFrame:
    """Cells in the order of the Hilbert keys of their boxes' centres, by section; ready to be written.

    Cells that are near each other come to lie in the same row groups, whose box statistics are therefore small.
    """
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    limits = cells.groupBy("section").agg(
        F.min(cx).alias("_x0"), F.max(cx).alias("_x1"), F.min(cy).alias("_y0"), F.max(cy).alias("_y1"))

    def scaled(v: Column, low: str, high: str) -> Column:
        return F.coalesce(F.floor(F.try_divide(v - F.col(low), F.col(high) - F.col(low)) * ((1 << BITS) - 1)), F.lit(0))

    placed = cells.join(limits, cells["section"].eqNullSafe(limits["section"])).drop(limits["section"])
    keyed = placed.withColumn("_hilbert", hilbert(scaled(cx, "_x0", "_x1"), scaled(cy, "_y0", "_y1")))
    order = ["section", "_hilbert", "shape_ord"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*cells.columns)


def write_cells(cells: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Write cells along the Hilbert curve, in row groups of about ``group_bytes``."""
    # Bounds are checked per row group, so a group must not wait for the default of 128 MB.
    hilbert_layout(cells).write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 100).parquet(path)


def write_cell_index(points: DataFrame, path: str, exact: bool = True, files: int | None = None) -> None:
    """The per-cell index at ``path``: points ordered by cell, in ``files`` files, and where each cell lies in which file.

    ``points`` holds the rows of :func:`cell_transcripts`; ``slices`` has one row per cell and file with its first row, the
    row after its last, and the file's name; ``files`` has the first and last cell of each file.
    """
    cell_transcripts(points, exact, files).write.parquet(f"{path}/points")
    stored = points.sparkSession.read.parquet(f"{path}/points")
    key = cell_key(stored)
    row = F.col("_metadata.row_index")
    slices = stored.groupBy(*key, F.col("_metadata.file_path").alias("file")).agg(F.min(row).alias("start"), (F.max(row) + 1).alias("end"))
    slices.repartitionByRange(*key, "start").sortWithinPartitions(*key).write.parquet(f"{path}/slices")
    written = points.sparkSession.read.parquet(f"{path}/slices")
    ends = F.struct(*key)
    written.groupBy("file").agg(F.min(ends).alias("first"), F.max(ends).alias("last"), F.sum(F.col("end") - F.col("start")).alias("n")).coalesce(1).write.parquet(
        f"{path}/files")


def files_of_cells(spark: SparkSession, path: str, requested: DataFrame | list[dict], exact: bool = True) -> list[str]:
    """Files of an index that hold the requested cells.

    A list of cells (dicts of key columns) is compared with the cell range of each file; a table is joined with the
    slices. Names of files are listed on the driver, as any scan of them does.
    """
    if isinstance(requested, list):
        files = spark.read.parquet(f"{path}/files")
        names = files.schema["first"].dataType.names
        hit = F.lit(False)
        for cell in requested:
            here = F.struct(*(F.lit(cell[k]).cast(files.schema["first"].dataType[k].dataType).alias(k) for k in names))
            hit = hit | ((F.col("first") <= here) & (here <= F.col("last")))
        return sorted(r.file for r in files.filter(hit).select("file").collect())
    slices = spark.read.parquet(f"{path}/slices")
    key = cell_key(slices, requested)
    wanted = requested.withColumn("cell_id", normalize_cell_key("cell_id", exact)).select(*key).distinct()
    return sorted(r.file for r in slices.join(wanted, key, "left_semi").select("file").distinct().collect())


def look_up_cells(spark: SparkSession, path: str, requested: DataFrame | list[dict], exact: bool = True) -> DataFrame:
    """Points of the requested cells from an index: only files that hold one of them are opened; unknown cells give none."""
    files = files_of_cells(spark, path, requested, exact)
    schema = spark.read.parquet(f"{path}/points").schema
    if not files:
        return spark.createDataFrame([], schema)
    points = spark.read.schema(schema).parquet(*files)
    if isinstance(requested, list):
        hit = F.lit(False)
        for cell in requested:
            same = F.lit(True)
            for k, v in cell.items():
                same = same & (F.col(k) == F.lit(v))
            hit = hit | same
        return points.filter(hit)
    key = cell_key(points, requested)
    wanted = requested.withColumn("cell_id", normalize_cell_key("cell_id", exact)).select(*key).distinct()
    return points.join(wanted, key, "left_semi")
