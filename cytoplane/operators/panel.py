"""The marker reference: genes grouped by the cell types they mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions.text import is_control_gene
from cytoplane.operators.transcripts import MARKER_GROUPS

CONTROL_GROUP = "Control / blank probes"
PLAIN_GROUP = "Genes"


def annotate_genes(panel: DataFrame, reference: DataFrame) -> DataFrame:
    """Broad and fine type of each gene, and the text shown for it."""
    joined = panel.join(reference.select("gene", "broad", "fine"), "gene", "left")
    known = F.col("broad").isNotNull()
    fine = F.coalesce("fine", F.lit(""))
    title = F.when(fine != "", F.concat_ws(" / ", "broad", fine)).otherwise(F.col("broad"))
    return joined.select(
        *panel.columns,
        F.coalesce("broad", F.lit(CONTROL_GROUP)).alias("broad"),
        fine.alias("fine"),
        F.when(known, title).otherwise(F.lit(CONTROL_GROUP)).alias("cell_type"),
    )


def genes_without_reference(panel: DataFrame, reference: DataFrame) -> DataFrame:
    return panel.join(reference.select("gene"), "gene", "left_anti")


def has_reference_genes(panel: DataFrame, reference: DataFrame) -> bool:
    """Whether any panel gene is in the reference; without one all genes form one group."""
    return not panel.join(reference.select("gene"), "gene", "left_semi").limit(1).isEmpty()


def plain_if_unknown(annotated: DataFrame) -> DataFrame:
    """Annotated genes, in the one group "Genes" if the reference knows none of them."""
    known = annotated.agg(F.max(F.col("broad") != CONTROL_GROUP)).scalar()
    return annotated.withColumn("broad", F.when(known, F.col("broad")).otherwise(F.lit(PLAIN_GROUP)))


def marker_group_by_broad(annotated: DataFrame) -> DataFrame:
    """Genes cycling through the marker groups inside their broad type."""
    rank = F.row_number().over(Window.partitionBy("broad").orderBy("gene")) - 1
    return annotated.withColumn("marker_group", (rank % MARKER_GROUPS).cast("bigint"))


def gene_groups(annotated: DataFrame, fine: bool = False) -> DataFrame:
    """Ordered member genes of each broad type, or of each (broad, fine) pair."""
    keys = ["broad", "fine"] if fine else ["broad"]
    return annotated.groupBy(*keys).agg(F.sort_array(F.collect_list("gene")).alias("genes"))


def panel_grouped(annotated: DataFrame, fine: bool = False) -> DataFrame:
    """Header and member rows in display order: types alphabetical, control group last.

    Where the reference knows none of the genes, all of them are members of the one group "Genes".
    """
    annotated = plain_if_unknown(annotated)
    control = F.col("broad") == CONTROL_GROUP
    named = annotated.withColumn("is_control_group", control)
    if fine:
        title = F.when(F.col("fine") != "", F.concat_ws(" — ", "broad", "fine")).otherwise(F.col("broad"))
        keys = ["is_control_group", "broad", "fine"]
    else:
        title = F.col("broad")
        keys = ["is_control_group", "broad"]
    members = named.withColumn("title", title).select(*keys, "title", "gene")
    headers = members.select(*keys, "title").distinct().withColumn("gene", F.lit(None).cast("string"))
    return members.unionByName(headers).orderBy(*keys, F.asc_nulls_first("gene"))


def search_panel(grouped: DataFrame, text: str, show_controls: bool = False) -> DataFrame:
    """Which genes and headings match a search; a heading stays while one of its genes does."""
    needle = text.strip().lower()
    match = F.lower("gene").contains(needle) if needle else F.lit(True)
    if not show_controls:
        match = match & ~is_control_gene("gene")
    group_shown = F.max("shown").over(Window.partitionBy("title"))
    return grouped.withColumn("shown", match).withColumn("group_shown", group_shown)


def search_labels(grouped: DataFrame, text: str) -> DataFrame:
    """The same search over cell types grouped under headings."""
    needle = text.strip().lower()
    match = F.lower("label").contains(needle) if needle else F.lit(True)
    return grouped.withColumn("shown", match).withColumn(
        "group_shown", F.max("shown").over(Window.partitionBy("title"))
    )
