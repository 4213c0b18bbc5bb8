"""Spatial joins as equi-joins on grid cells.

Boxes are binned on grids whose side doubles from level to level. A box lies on the level whose
side is at least half its own, so it covers at most nine grid cells however large it is; points are
looked up once on each level in use. One huge or stray polygon therefore costs nine rows.
A crowded grid cell is a skewed join partition, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.session import materialize

MIN_LEVEL = -16
#: Rows of one group above which the group is dealt out to several tasks.
GROUP_ROWS = 200_000
#: How many times the limit a part may have that is dealt out by a hash.
UNEVEN = 3


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _level(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    extent = F.greatest(xmax - xmin, ymax - ymin, F.lit(2.0**MIN_LEVEL))
    return (F.ceil(F.log2(extent)) - 1).cast("int")


def _span(low: Column, high: Column, level: Column) -> Column:
    return F.sequence(F.floor(low / _side(level)), F.floor(high / _side(level)))


def _levels_in_use(boxes: DataFrame) -> Column:
    """Levels that hold a box, as one small array (there are at most a few dozen)."""
    return boxes.agg(F.array_sort(F.collect_set("_level"))).scalar()


def place_boxes(df: DataFrame) -> DataFrame:
    """Rows with a box ``xmin..ymax``, one row per grid cell of their own level."""
    level = df.withColumn("_level", _level(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
    return level.withColumn("_gx", F.explode(_span(F.col("xmin"), F.col("xmax"), F.col("_level")))).withColumn(
        "_gy", F.explode(_span(F.col("ymin"), F.col("ymax"), F.col("_level")))
    )


def place_points(df: DataFrame, boxes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with a point, one row per level on which ``boxes`` has any box."""
    levelled = boxes.select(_level(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("_level"))
    return (
        df.withColumn("_levels", _levels_in_use(levelled))
        .withColumn("_level", F.explode_outer("_levels"))
        .drop("_levels")
        .withColumn("_gx", F.floor(F.col(x) / _side(F.col("_level"))))
        .withColumn("_gy", F.floor(F.col(y) / _side(F.col("_level"))))
    )


def meeting_boxes(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Pairs of boxes that overlap (closed) and satisfy ``condition``, each pair once.

    Columns other than ``on`` are prefixed ``l_`` and ``r_``; ``condition`` uses those names. A pair
    meets on the coarser of its two levels: the coarser box at home, the finer one as a guest. Guests are
    joined to hosts only, never to each other, so small boxes do not meet on a large box's level. A pair is
    kept only in the grid cell of its overlap's lower corner, so no distinct is needed.
    """
    box = ("xmin", "ymin", "xmax", "ymax")

    def prefixed(df: DataFrame, tag: str) -> DataFrame:
        named = df.select(*on, *(F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in on))
        return named.withColumn(f"_{tag}_level", _level(*(F.col(f"{tag}_{c}") for c in box)))

    a, b = prefixed(left, "l"), prefixed(right, "r")

    def spread(df: DataFrame, tag: str) -> DataFrame:
        for axis in ("x", "y"):
            span = _span(F.col(f"{tag}_{axis}min"), F.col(f"{tag}_{axis}max"), F.col("_level"))
            df = df.withColumn(f"_g{axis}", F.explode(span))
        return df

    def at_home(df: DataFrame, tag: str) -> DataFrame:
        return spread(df.withColumn("_level", F.col(f"_{tag}_level")), tag)

    def guests(df: DataFrame, tag: str, hosts: DataFrame, host: str, own: bool) -> DataFrame:
        """On every level of a host that is coarser than the box's own, or the same if ``own``."""
        levels = _levels_in_use(hosts.select(F.col(f"_{host}_level").alias("_level")))
        every = df.withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).drop("_levels")
        mine = F.col(f"_{tag}_level")
        return spread(every.filter(F.col("_level") >= mine if own else F.col("_level") > mine), tag)

    overlap = (
        (F.col("l_xmin") <= F.col("r_xmax"))
        & (F.col("r_xmin") <= F.col("l_xmax"))
        & (F.col("l_ymin") <= F.col("r_ymax"))
        & (F.col("r_ymin") <= F.col("l_ymax"))
    )
    corner = (F.floor(F.greatest("l_xmin", "r_xmin") / _side(F.col("_level"))) == F.col("_gx")) & (
        F.floor(F.greatest("l_ymin", "r_ymin") / _side(F.col("_level"))) == F.col("_gy")
    )
    keys = [*on, "_level", "_gx", "_gy"]
    met = guests(a, "l", b, "r", own=True).join(at_home(b, "r"), keys).unionByName(
        at_home(a, "l").join(guests(b, "r", a, "l", own=False), keys)
    )
    return met.filter(overlap & corner & condition).drop("_level", "_gx", "_gy", "_l_level", "_r_level")


def split_hot(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    by: Column | None,
    limit: int = GROUP_ROWS,
    counted: DataFrame | None = None,
    *,
    guess: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a cogroup on ``keys`` with ``_salt``, so that no group has much more than ``limit`` rows of ``many``.

    Rows of a larger group are dealt out by ``by``, or by ``guess`` where that leaves no part of several times the limit (they are
    counted again), or by a number that each row is stored with; its rows of ``few`` go to all parts. Use the keys and ``_salt`` for the
    cogroup. Groups are counted first (in ``counted``, where that has the same keys and is cheaper); those above the limit
    are stored, at most one per ``limit`` rows, and joined only if there are any.
    """
    size = (many if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > limit)
    hot = materialize(size.select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.ceil(F.col("_size") / limit).cast("int").alias("_parts")))
    if hot.isEmpty():
        return many.withColumn("_salt", F.lit(0)), few.withColumn("_salt", F.lit(0))
    names = [c for c in hot.columns if c != "_parts"]

    def parts(df: DataFrame) -> DataFrame:
        # One row per ``limit`` rows at most, so it is sent to all tasks.
        same = [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
        return df.join(F.broadcast(hot), same, "left").drop(*names).withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    def dealt_by(df: DataFrame, number: Column) -> DataFrame:
        return parts(df).withColumn("_salt", F.pmod(number, F.col("_parts")).cast("int"))

    if by is None and guess is not None:
        uneven = dealt_by(many, guess).filter(F.col("_parts") > 1).groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_size"))
        if uneven.filter(F.col("_size") > UNEVEN * limit).isEmpty():
            by = guess
    if by is None:
        many, by = materialize(many.withColumn("_number", F.monotonically_increasing_id())), F.col("_number")
    dealt = dealt_by(many, by).drop("_parts", "_number")
    copied = parts(few).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt, copied


def common_levels(boxes: DataFrame, share: float = 0.9) -> tuple[int, list[int]]:
    """Levels to look points up on: a base, and the levels in use, at most a few dozen numbers.

    Boxes smaller than those of the base move up to it, the level that holds the ``share`` of all boxes together with
    the finer ones; so a point needs few look-ups.
    """
    own = boxes.select(_level(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("_own"))
    counts = own.groupBy("_own").agg(F.count(F.lit(1)).alias("_n")).orderBy("_own").collect()  # one row per level
    seen, total, base = 0, sum(r["_n"] for r in counts), MIN_LEVEL
    for row in counts:
        seen += row["_n"]
        if seen >= share * total:
            base = row["_own"]
            break
    return base, sorted({max(r["_own"], base) for r in counts}) or [base]
