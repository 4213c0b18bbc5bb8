"""Uniform samples of an exact size, and the clustered layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.session import materialize

_STEP = 16
_COPIES = 100_000


def _histogram(df: DataFrame, bucket: Column) -> list[tuple[int, int]]:
    """Rows per bucket in bucket order. At most 2**16 pairs reach the driver."""
    rows = df.groupBy(bucket.alias("b")).count().collect()
    return sorted((int(r["b"]), int(r["count"])) for r in rows)


def with_copy_ordinal(df: DataFrame) -> DataFrame:
    """Number identical rows 0, 1, 2, … so that each copy is a row of its own.

    Copies are counted before the shuffle and laid out again in slices, so a large group of copies
    is neither sent to nor expanded in one task.
    """
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_m"))
    slices = counted.select(
        *names,
        "_m",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_m") - 1) / _COPIES))).alias("_s"),
    ).repartition(*names, "_s")
    first = F.col("_s") * _COPIES
    last = F.least(first + _COPIES, F.col("_m")) - 1
    return slices.select(*names, F.explode(F.sequence(first, last)).alias("copy_ordinal"))


def exact_sample(df: DataFrame, n: int, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """A uniform sample of exactly ``n`` rows (all rows if there are fewer), fixed by ``seed``.

    Each row gets a 64-bit hash of its unique ``key`` and the ``n`` smallest are kept. The cut-off is
    found from histograms of 16 hash bits at a time, so nothing is sorted globally and the selected
    rows never move. Without a key the whole row is used, with an ordinal for repeated rows (which
    costs a shuffle of the table, so give a key where there is one).
    """
    names = df.columns
    source = df if key else with_copy_ordinal(df)
    key = key or [*names, "copy_ordinal"]
    # Flip the sign bit so that signed order equals the order of the 16-bit digits.
    hashed = source.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    digit = [
        F.shiftrightunsigned("_h", 64 - _STEP * (i + 1)).bitwiseAND(F.lit((1 << _STEP) - 1)) for i in range(4)
    ]
    if n <= 0:
        return df.limit(0)

    keys = hashed.select("_h", *key)
    prefix: list[int] = []
    left = n
    for level in range(4):
        if level == 1:
            keys = materialize(keys.filter(digit[0] == prefix[0]))
        inside = keys
        for i in range(level):
            inside = inside.filter(digit[i] == prefix[i])
        cut = None
        for bucket, count in _histogram(inside, digit[level]):
            if count > left:
                cut = bucket
                break
            left -= count
            if left == 0:
                cut = bucket + 1
                break
        if cut is None:
            return source.select(*names)
        prefix.append(cut)
        if left == 0:
            break

    below = F.lit(False)
    for i in range(len(prefix) - 1, -1, -1):
        below = (digit[i] < prefix[i]) | ((digit[i] == prefix[i]) & below)
    if left == 0:
        return hashed.filter(below).select(*names)
    # Only keys whose whole 64-bit hash collides are left: settle them by key order.
    tied = F.lit(True)
    for i in range(4):
        tied = tied & (digit[i] == prefix[i])
    chosen = keys.filter(tied).select(*key).orderBy(*key).limit(left)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    ties = hashed.filter(tied).alias("s").join(chosen.alias("c"), same, "left_semi")
    return hashed.filter(below).unionByName(ties.select(*hashed.columns)).select(*names)


def clustered_layout(points: DataFrame, codes: DataFrame) -> DataFrame:
    """Physical order (marker group, gene code, background), ready to be written as Parquet.

    Range bounds include the coordinates, so a gene that holds a large share of all points is split
    over many partitions and the files stay even.
    """
    coded = points.join(codes, "gene")
    order = ["marker_group", "gene_code", "background", "x", "y"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order)
