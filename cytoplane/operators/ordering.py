"""Global order without a single-task window.

Rows are range-partitioned and sorted, then written to the checkpoint folder once, so that every
later step sees the same partitions. Positions and running totals are then local work plus one
offset per partition, and only those offsets (one row per partition) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.session import materialize

_IN_PARTITION = (1 << 33) - 1


def _sorted_once(df: DataFrame, by: list[str]) -> DataFrame:
    """Sorted, materialised rows with their partition and position. ``by`` must be unique."""
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    fixed = materialize(placed)
    return fixed.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_IN_PARTITION))
    ).drop("_mid")


def _offsets(df: DataFrame, amount: Column) -> DataFrame:
    """Total of all earlier partitions; one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    return totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def global_index(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the order of unique columns ``by``."""
    rows = _sorted_once(df, by)
    base = F.broadcast(_offsets(rows, F.lit(1)))
    return rows.join(base, "_part").withColumn(name, F.col("_base") + F.col("_pos")).drop("_part", "_pos", "_base")


def running_total(df: DataFrame, by: list[str], amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one in the order of unique ``by``."""
    rows = _sorted_once(df, by)
    base = F.broadcast(_offsets(rows, F.col(amount)))
    before = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(before), F.lit(0))
    return rows.withColumn("_in", inside).join(base, "_part").withColumn(
        name, F.col("_base") + F.col("_in")
    ).drop("_part", "_pos", "_base", "_in")


def exact_percentiles(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group.

    Equal values are counted before the shuffle, so neither a hot group nor a hot value lands in one
    task; ranks then come from a running total over the distinct values.
    """
    counts = df.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [*group, "_v"], "_n", "_start")
    base = ranked.groupBy(*group).agg(F.min("_start").alias("_base"), F.sum("_n").alias("_total"))
    if group:
        placed = ranked.join(base, group)
    else:
        one = base.select(F.struct("_base", "_total").alias("_b")).scalar()
        placed = ranked.withColumn("_b", one).select("*", "_b._base", "_b._total")
    first = F.col("_start") - F.col("_base")
    picks = []
    for name, fraction in fractions.items():
        at = F.lit(float(fraction)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (first <= rank) & (rank < first + F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
    found = placed.groupBy(*group).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, fraction in fractions.items():
        at = F.lit(float(fraction)) * (F.col("_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.filter(F.col("_total").isNotNull()).select(*group, F.col("_total").alias("n"), *out)


def running_in_group(
    df: DataFrame, group: list[str], by: list[str], amount: str, name: str, how: str = "sum", inclusive: bool = False
) -> DataFrame:
    """Running sum or maximum inside each group, in the order of ``by`` (unique within a group).

    A group larger than a partition is carried over from partition to partition, so its size does
    not matter: each task sees one slice, and the carries are one row per group and partition.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = _sorted_once(df, [*group, *by])
    slices = [*group, "_part"]
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*slices).orderBy("_pos").rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*slices).agg(fold(amount).alias("_all")).select(*slices, fold("_all").over(earlier).alias("_carry"))
    joined = rows.withColumn("_in", fold(amount).over(inside)).join(carry, slices)
    if how == "sum":
        value = F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        value = F.greatest("_in", "_carry")
    return joined.withColumn(name, value).drop("_part", "_pos", "_in", "_carry")
