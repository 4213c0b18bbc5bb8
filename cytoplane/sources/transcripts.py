"""Transcript tables: column names, canonical form, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.operators.transcripts import with_background

# Names a column may have, the first one present wins.
X_NAMES = ("x", "x_micron", "global_x", "x_location", "observed_x")
Y_NAMES = ("y", "y_micron", "global_y", "y_location", "observed_y")
ASSIGNMENT_NAMES = ("assignment", "cell", "cell_id")
GENE_NAMES = ("gene", "feature_name", "target", "feature_id", "gene_id")

#: Row identity that a file scan gives for free: which file, which row.
ROW_KEY = ("source_file", "source_row")


def first_present(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    return next((name for name in candidates if name in columns), None)


def resolve_columns(columns: list[str]) -> dict[str, str | None]:
    """Map canonical names to the names a table uses. Coordinates and gene must be there."""
    found = {
        "x": first_present(columns, X_NAMES),
        "y": first_present(columns, Y_NAMES),
        "gene": first_present(columns, GENE_NAMES),
        "assignment": first_present(columns, ASSIGNMENT_NAMES),
        "background": "background" if "background" in columns else None,
    }
    missing = [name for name in ("x", "y", "gene") if found[name] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return found


def canonical_transcripts(df: DataFrame, section: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select and rename the transcript columns. Nothing else is read."""
    columns = []
    for name, source in resolve_columns(df.columns).items():
        if source is None:
            continue
        column = F.col(f"`{source}`")
        if name in ("x", "y"):
            column = column.cast("double")
        elif name == "gene":
            column = column.cast("string")
        elif name == "background":
            column = column.cast("boolean")
        columns.append(column.alias(name))
    lead = [] if section is None else [F.lit(section).alias("section")]
    return df.select(*lead, *columns, *keep)


def scan_transcripts(spark: SparkSession, path: str, section: str | None = None, row_key: bool = False) -> DataFrame:
    """Canonical transcripts of a Parquet table, optionally with the row's place as its key."""
    raw = spark.read.parquet(path)
    if row_key:
        raw = raw.withColumns(
            {ROW_KEY[0]: F.col("_metadata.file_path"), ROW_KEY[1]: F.col("_metadata.row_index")}
        )
    return canonical_transcripts(raw, section, ROW_KEY if row_key else ())


def union_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """Several sections in one table. Ids are text, because platforms type them differently."""
    out = None
    for name, df in sections.items():
        # Each section says itself what background is, by its own columns.
        one = with_background(canonical_transcripts(df, name))
        if "assignment" in one.columns:
            one = one.withColumn("assignment", F.col("assignment").cast("string"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no section to open")
    return out
