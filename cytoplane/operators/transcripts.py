"""Filters, counts, windows and orders over transcript points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.functions.geometry import finite
from cytoplane.functions.text import is_assigned, is_control_gene, normalize_cell_key
from cytoplane.operators.ordering import global_index, running_total

MARKER_GROUPS = 14
CELL_KEY = ("section", "seg_key", "cell_id")


def valid_points(points: DataFrame) -> DataFrame:
    """Points with finite coordinates and a gene."""
    return points.filter(finite(F.col("x")) & finite(F.col("y")) & F.col("gene").isNotNull())


def assigned_flag(points: DataFrame) -> Column:
    """Whether each point is assigned to a cell; false where the table has no assignment."""
    if "assignment" not in points.columns:
        return F.lit(False)
    return is_assigned("assignment", points.schema["assignment"].dataType)


def background_flag(points: DataFrame) -> Column:
    """The background column if there is one (null: false), else "not assigned", else false."""
    if "background" in points.columns:
        return F.coalesce(F.col("background").cast("boolean"), F.lit(False))
    if "assignment" in points.columns:
        return ~assigned_flag(points)
    return F.lit(False)


def with_background(points: DataFrame) -> DataFrame:
    return points.withColumn("background", background_flag(points))


def cell_key(*tables: DataFrame) -> list[str]:
    """The columns that tell cells apart: the id, with section and segmentation where every table has them."""
    return [c for c in CELL_KEY if c == "cell_id" or all(c in t.columns for t in tables)]


def assigned_points(points: DataFrame, exact: bool = True) -> DataFrame:
    """Valid assigned points keyed by normalised cell id; blank keys are dropped."""
    kept = valid_points(points).filter(assigned_flag(points))
    dtype = points.schema["assignment"].dataType
    key = F.col("assignment").cast("string") if isinstance(dtype, T.IntegralType) else normalize_cell_key(
        "assignment", exact
    )
    return kept.withColumn("cell_id", key).filter(F.col("cell_id") != "")


def visible_transcripts(
    points: DataFrame,
    enabled: DataFrame,
    hide_assigned: bool = False,
    hide_background: bool = False,
    show_controls: bool = False,
) -> DataFrame:
    """Points of enabled genes, with foreground, background or control probes hidden on demand."""
    shown = with_background(valid_points(points))
    if hide_assigned:
        shown = shown.filter(F.col("background"))
    if hide_background:
        shown = shown.filter(~F.col("background"))
    genes = enabled.select("gene").distinct()
    if not show_controls:
        shown = shown.filter(~is_control_gene("gene"))
    return shown.join(genes, "gene", "left_semi")


def gene_counts(points: DataFrame) -> DataFrame:
    return valid_points(points).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


def point_totals(points: DataFrame, max_points: int | None = None) -> DataFrame:
    """Source total, rendered total under the cap, and whether that is a sample."""
    total = valid_points(points).agg(F.count(F.lit(1)).alias("source_total"))
    cap = F.lit(max_points).cast("bigint") if max_points and max_points > 0 else F.col("source_total")
    return total.withColumn("rendered_total", F.least(cap, "source_total")).withColumn(
        "sampled", F.col("rendered_total") < F.col("source_total")
    )


def cell_counts(points: DataFrame, exact: bool = True) -> DataFrame:
    kept = assigned_points(points, exact)
    return kept.groupBy(*cell_key(kept)).agg(F.count(F.lit(1)).alias("n"))


def gene_fg_bg_counts(points: DataFrame) -> DataFrame:
    shown = with_background(valid_points(points))
    return shown.groupBy("gene").agg(
        F.count_if(~F.col("background")).alias("fg"),
        F.count_if(F.col("background")).alias("bg"),
    )


def cell_gene_counts(points: DataFrame, exact: bool = True) -> DataFrame:
    kept = assigned_points(points, exact)
    return kept.groupBy(*cell_key(kept), "gene").agg(F.count(F.lit(1)).alias("n"))


def cell_transcripts(points: DataFrame, exact: bool = True, partitions: int | None = None) -> DataFrame:
    """The per-cell index: every assigned point, physically ordered by cell, in ``partitions`` or as many as Spark finds good.

    Rows stay rows. Range bounds include the coordinates, so a cell with very many transcripts is
    spread over several partitions instead of becoming one array; a look-up of one cell prunes to the
    row groups that hold it.
    """
    kept = assigned_points(points, exact)
    order = [*cell_key(kept), "y", "x", "gene"]
    keyed = kept.select(*order)
    return keyed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)


def cell_slices(points: DataFrame, exact: bool = True) -> DataFrame:
    """Where each cell starts and ends in the order of :func:`cell_transcripts`."""
    counts = cell_counts(points, exact)
    key = cell_key(counts)
    placed = running_total(counts, key, "n", "start")
    return placed.select(*key, "start", (F.col("start") + F.col("n")).alias("end"))


def transcripts_for_cells(points: DataFrame, requested: DataFrame, exact: bool = True) -> DataFrame:
    """Assigned points of the requested cells; unknown cells give no rows.

    Cells are asked for by section and segmentation too, where both tables have these.
    """
    kept = assigned_points(points, exact)
    key = cell_key(kept, requested)
    wanted = requested.withColumn("cell_id", normalize_cell_key("cell_id", exact)).select(*key).distinct()
    return kept.select(*cell_key(kept), "y", "x", "gene").join(wanted, key, "left_semi")


def gene_codes(points: DataFrame) -> DataFrame:
    """Dense 0-based code of each gene in alphabetical order."""
    return global_index(panel(points), ["gene"], "gene_code")


def marker_group(points: DataFrame) -> DataFrame:
    """Genes cycling through the marker groups in alphabetical order."""
    return gene_codes(points).withColumn("marker_group", F.col("gene_code") % MARKER_GROUPS)


def gene_offsets(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Start, end of foreground and end of each gene inside its marker group.

    ``counts`` has one row per gene (fg, bg) and ``groups`` its marker group; the running sums are
    over genes, never over points.
    """
    return _placed(counts, groups).select("gene", "marker_group", "fg_start", "fg_end", "bg_end")


def _placed(counts: DataFrame, groups: DataFrame) -> DataFrame:
    sized = counts.join(groups.select("gene", "marker_group"), "gene").withColumn("n", F.col("fg") + F.col("bg"))
    before = Window.partitionBy("marker_group").orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return sized.withColumn("fg_start", start).select(
        *counts.columns,
        "marker_group",
        "fg_start",
        (F.col("fg_start") + F.col("fg")).alias("fg_end"),
        (F.col("fg_start") + F.col("n")).alias("bg_end"),
    )


def ranked_genes(counts: DataFrame, top: int | None = None) -> DataFrame:
    """Genes of each cell by count, then name. Rows are (cell, gene) counts, not points."""
    order = Window.partitionBy(*cell_key(counts)).orderBy(F.desc("n"), F.asc("gene"))
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def gene_share(counts: DataFrame) -> DataFrame:
    """Part of each gene in its cell's transcripts."""
    total = F.sum("n").over(Window.partitionBy(*cell_key(counts)))
    return counts.withColumn("share", F.col("n") / total.cast("double"))


def panel(points: DataFrame) -> DataFrame:
    return valid_points(points).select("gene").distinct()


def panel_alphabetical(points: DataFrame) -> DataFrame:
    return panel(points).orderBy("gene")


def enabled_genes(points: DataFrame, show_controls: bool = False) -> DataFrame:
    """The panel without control probes, unless they are shown."""
    genes = panel(points)
    return genes if show_controls else genes.exceptAll(genes.filter(is_control_gene("gene")))


def gene_panel(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The panel report from the counts of its genes: control flag, marker group and offsets."""
    return _placed(counts, groups).withColumn("is_control", is_control_gene("gene")).orderBy("marker_group", "gene")
