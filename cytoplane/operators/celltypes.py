"""Per-cell labels and values: joins to cells, counts, clip ranges and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions.bins import VALUE_BINS, value_bin
from cytoplane.functions.geometry import finite
from cytoplane.functions.text import is_missing_label, normalize_cell_key, strip
from cytoplane.operators.ordering import exact_percentiles, global_index

UNANNOTATED = "Unannotated"

# Percentiles of the clip range.
CLIP_LOW = 0.01
CLIP_HIGH = 0.99


def drop_missing_labels(rows: DataFrame) -> DataFrame:
    """Keep cells with a broad label and a numeric id; a missing fine label becomes the broad one."""
    return rows.filter(~is_missing_label("broad") & F.col("cell_id").isNotNull()).withColumn(
        "fine", F.when(is_missing_label("fine"), F.col("broad")).otherwise(strip("fine"))
    )


def enabled_cell_types(cells: DataFrame, enabled: DataFrame | None, level: str = "broad") -> DataFrame:
    """Cells whose label is switched on; no list means all."""
    if enabled is None:
        return cells
    return cells.join(enabled.select(F.col("label").alias(level)).distinct(), level, "left_semi")


def annotate_cells(cells: DataFrame, types: DataFrame, exact: bool = True) -> DataFrame:
    """Broad and fine label of each cell, matched on the normalised id and what else both tables tell cells apart by."""
    on = [c for c in ("section", "seg_key") if c in cells.columns and c in types.columns]
    labels = types.select(*on, normalize_cell_key("cell_id", exact).alias("_key"), "broad", "fine")
    keyed = cells.withColumn("_key", normalize_cell_key("cell_id", exact))
    return keyed.join(labels, [*on, "_key"], "left").select(
        *cells.columns,
        F.coalesce("broad", F.lit(UNANNOTATED)).alias("broad"),
        F.coalesce("fine", F.lit(UNANNOTATED)).alias("fine"),
    )


def cell_type_counts(cells: DataFrame, level: str = "broad") -> DataFrame:
    return cells.groupBy(F.col(level).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def type_groups(cells: DataFrame) -> DataFrame:
    """Distinct fine labels under each broad one, from the pairing of the cells themselves."""
    pairs = cells.filter(~is_missing_label("broad")).select("broad", "fine").distinct()
    return pairs.groupBy("broad").agg(F.sort_array(F.collect_list("fine")).alias("fines"))


def resolve_feature(features: DataFrame, channel: str, statistic: str) -> DataFrame:
    """The first feature, by column order, of a channel and statistic whatever their case."""
    same = (F.lower("channel") == channel.lower()) & (F.lower("statistic") == statistic.lower())
    return features.filter(same).agg(
        F.min_by("feature", "column_index").alias("feature"), F.min("column_index").alias("column_index")
    ).filter(F.col("column_index").isNotNull())


def select_quantification(values: DataFrame, features: DataFrame, channel: str, statistic: str) -> DataFrame:
    """Label ids and the values of one feature. The chosen column is a one-value subquery, so the
    filter reaches the scan and no join is needed."""
    chosen = resolve_feature(features, channel, statistic).select("column_index").scalar()
    return values.filter(F.col("column_index") == chosen).select("label_id", "value")


def value_clip_range(
    values: DataFrame, group: list[str] | None = None, low: float = CLIP_LOW, high: float = CLIP_HIGH
) -> DataFrame:
    """Exact percentile limits over all finite values, per group. A group without one has no row."""
    usable = values.filter(finite(F.col("value")))
    return exact_percentiles(usable, group or [], "value", {"clip_low": low, "clip_high": high}).drop("n")


def require_clip_range(limits: DataFrame) -> DataFrame:
    """Fail, as a value overlay must, when no finite value was there to set the limits."""
    if limits.isEmpty():
        raise ValueError("no finite values to set a clip range from")
    return limits


def binned_values(
    values: DataFrame, limits: DataFrame, group: list[str] | None = None, bins: int = VALUE_BINS
) -> DataFrame:
    """Bin of every cell with a finite value and a label above zero."""
    usable = values.filter(finite(F.col("value")) & (F.col("label_id") > 0))
    if group:
        placed = usable.join(limits.select(*group, "clip_low", "clip_high"), group)
    else:
        both = limits.select(F.struct("clip_low", "clip_high").alias("_c")).scalar()
        placed = usable.withColumn("_c", both).select(*usable.columns, "_c.clip_low", "_c.clip_high")
    found = value_bin(F.col("value"), F.col("clip_low"), F.col("clip_high"), bins)
    return placed.withColumn("bin", found).drop("clip_low", "clip_high")


def overlay_stats(
    values: DataFrame, binned: DataFrame, group: list[str] | None = None
) -> DataFrame:
    """How many labels there are, how many carry a finite value, and how many bins are in use.

    Bins are counted once per (group, bin) before the last step, so the distinct count is over at
    most as many rows as there are bins.
    """
    group = group or []
    labels = values.groupBy(*group).agg(F.count(F.lit(1)).alias("label_count"))
    per_bin = binned.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("_n"))
    used = per_bin.groupBy(*group).agg(F.sum("_n").alias("finite_count"), F.count(F.lit(1)).alias("bins_used"))
    if group:
        joined = labels.join(used, group, "left")
    else:
        one = used.select(F.struct("finite_count", "bins_used").alias("_u")).scalar()
        joined = labels.withColumn("_u", one).select("label_count", "_u.finite_count", "_u.bins_used")
    return joined.fillna(0, ["finite_count", "bins_used"])


def grid_origin_step(coords: DataFrame, group: list[str] | None = None) -> DataFrame:
    """First coordinate and spacing of each axis: the median step, or the first if steps vary.

    ``coords`` has (index, value) per group; a group is one axis of a raster. Consecutive
    values meet by an equi-join on the index, so no axis has to fit in one task.
    """
    group = group or []
    left, right = coords.select(*group, "index", "value"), coords.select(
        *group, (F.col("index") - 1).alias("index"), F.col("value").alias("_next")
    )
    steps = left.join(right, [*group, "index"]).select(*group, "index", (F.col("_next") - F.col("value")).alias("d"))
    median = exact_percentiles(steps, group, "d", {"step": 0.5})
    firsts = coords.groupBy(*group).agg(F.min_by("value", "index").alias("origin"))
    if group:
        judged = steps.join(median.select(*group, "step"), group)
    else:
        judged = steps.withColumn("step", median.select("step").scalar())
    far = F.abs(F.col("d") - F.col("step")) > F.lit(1e-6) + F.lit(1e-3) * F.abs("step")
    chosen = judged.groupBy(*group).agg(
        F.when(F.max(far), F.min_by("d", "index")).otherwise(F.max("step")).alias("step")
    )
    if group:
        joined = firsts.join(chosen, group, "left")
        return joined.withColumn("step", F.coalesce("step", F.lit(1.0)))
    return firsts.withColumn("step", F.coalesce(chosen.select("step").scalar(), F.lit(1.0))).withColumn(
        "origin", F.coalesce("origin", F.lit(0.0))
    )


def label_ids(shapes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Raster id of each shape: its own id where all ids of the group are whole numbers from zero
    up, otherwise 1, 2, 3, … by first appearance.

    Whole ids stay exact as decimals; ``wide`` says whether 32 bits are too few for the group.
    """
    group = group or []
    number = F.col("cell_id").cast("string").try_cast("decimal(38,0)")
    exact = F.col("cell_id").cast("string").rlike(r"^\s*\+?\d+(\.0*)?\s*$")
    firsts = shapes.groupBy(*group, "cell_id").agg(
        F.min("shape_ord").alias("_first"),
        F.max(F.when(exact, number)).alias("_number"),
    )
    placed = global_index(firsts, [*group, "_first", "cell_id"], "_at")
    facts = placed.groupBy(*group).agg(
        F.every(F.col("_number").isNotNull()).alias("_numeric"),
        F.min("_at").alias("_base"),
        F.max("_number").alias("_top"),
        F.count(F.lit(1)).alias("_n"),
    )
    if group:
        joined = placed.join(facts, group)
    else:
        one = facts.select(F.struct("_numeric", "_base", "_top", "_n").alias("_f")).scalar()
        joined = placed.withColumn("_f", one).select(*placed.columns, "_f.*")
    code = (F.col("_at") - F.col("_base") + 1).cast("decimal(38,0)")
    top = F.when(F.col("_numeric"), F.col("_top")).otherwise(F.col("_n").cast("decimal(38,0)"))
    return joined.select(
        *group,
        "cell_id",
        F.when(F.col("_numeric"), F.col("_number")).otherwise(code).alias("label_id"),
        (top > F.lit(2**32 - 1)).alias("wide"),
    )

