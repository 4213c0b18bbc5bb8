"""The driver's tables read as spatial-transcriptomics tables.

Each adapter exists twice: as a DataFrame for Spark, and in ``VIEWS`` as portable SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.sources.cells import scan_cells, scan_image, scan_image_rows, scan_image_tiles, scan_labels

SECTION = "s1"

VIEWS = {
    "transcripts_v": """
        SELECT CASE WHEN p_size = 13 THEN 'Blank-' || p_name ELSE p_name END AS gene,
               CAST((l_orderkey*13 + l_partkey*7) % 1000 AS DOUBLE) + l_quantity / CAST(64 AS DOUBLE) AS x,
               CAST((l_partkey*29 + l_suppkey*17 + l_linenumber*101) % 1000 AS DOUBLE)
                 + CAST(l_linenumber AS DOUBLE) / CAST(16 AS DOUBLE) AS y,
               l_suppkey AS assignment,
               l_returnflag = 'R' AS background,
               l_linestatus AS platform
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "cells_v": """
        SELECT s_suppkey AS cell_id,
               CAST((s_suppkey % 10)*100 + 50 AS DOUBLE) AS cx,
               CAST((CAST(floor(s_suppkey/10) AS BIGINT) % 10)*100 + 50 AS DOUBLE) AS cy,
               CAST(40 + s_nationkey AS DOUBLE) AS w,
               s_suppkey % 3 = 0 AS sq,
               s_nationkey
        FROM supplier WHERE s_suppkey > 0""",
    "features_v": """
        SELECT c_custkey AS label_id, c_mktsegment AS channel, 'mean' AS statistic,
               CASE WHEN c_custkey % 37 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS value
        FROM customer""",
    "cell_types_raw_v": """
        SELECT CAST(s_suppkey AS VARCHAR(20)) AS cell,
               CASE r_name WHEN 'EUROPE' THEN 'neurons' WHEN 'ASIA' THEN 'nan' ELSE r_name END AS broad_class,
               CASE WHEN s_nationkey % 7 = 0 THEN 'none' ELSE n_name END AS hierarchical_cluster,
               CASE WHEN s_acctbal > 5000 THEN 'Excitatory' WHEN s_acctbal > 2000 THEN 'Inhibitory' END AS neuron_split_label
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cell_types_v": """
        SELECT cell_id, broad, CASE WHEN hierarchical_cluster = 'none' THEN broad ELSE hierarchical_cluster END AS fine
        FROM (SELECT CAST(cell AS BIGINT) AS cell_id, hierarchical_cluster,
                     CASE WHEN broad_class = 'neurons' AND neuron_split_label = 'Excitatory' THEN 'Excitatory neurons'
                          WHEN broad_class = 'neurons' AND neuron_split_label = 'Inhibitory' THEN 'Inhibitory neurons'
                          ELSE broad_class END AS broad
              FROM cell_types_raw_v) AS q
        WHERE broad <> 'nan'""",
    "marker_reference_v": """
        SELECT DISTINCT p_name AS gene, split_part(p_name, ' ', 1) AS broad, split_part(p_name, ' ', 2) AS fine
        FROM part WHERE split_part(p_name, ' ', 1) <> 'hot'""",
    "annotated_genes_v": """
        SELECT p.gene, coalesce(m.broad, 'Control / blank probes') AS broad, coalesce(m.fine, '') AS fine
        FROM (SELECT DISTINCT gene FROM transcripts_v) AS p LEFT JOIN marker_reference_v AS m ON p.gene = m.gene""",
    "gene_fg_bg_v": """
        SELECT gene, CAST(sum(CASE WHEN background THEN 0 ELSE 1 END) AS BIGINT) AS fg,
               CAST(sum(CASE WHEN background THEN 1 ELSE 0 END) AS BIGINT) AS bg
        FROM transcripts_v GROUP BY gene""",
    "assigned_v": "SELECT CAST(assignment AS VARCHAR) AS cell_id, gene, x, y FROM transcripts_v WHERE assignment > 0",
    "image_v": """
        SELECT vec_id AS r, generate_subscripts(embedding,1)-1 AS c, CAST(unnest(embedding) AS DOUBLE) AS value, label
        FROM embeddings""",
    "int_image_v": "SELECT r, c, CAST(floor(value*1000) AS BIGINT) AS value FROM image_v",
    "labels_v": """
        SELECT r, c, CASE WHEN label = 0 THEN 0
                          ELSE 1 + CAST(floor(r/6) AS BIGINT)*11 + CAST(floor(c/6) AS BIGINT) END AS value
        FROM image_v""",
    "raster_size_v": "SELECT max(vec_id) + 1 AS h, 64 AS w FROM embeddings",
    "annotations_v": """
        SELECT r_name AS section, 'side' AS role, CAST(NULL AS VARCHAR(20)) AS piece, so AS shape_ord, vo AS vertex_ord,
               CAST(vx AS DOUBLE) AS x, CAST(vy AS DOUBLE) AS y
        FROM region CROSS JOIN (VALUES (0,0,1000),(1,0,0),(2,1000,0),(3,1000,1000)) AS v(vo,vx,vy)
                    CROSS JOIN (VALUES (0),(1)) AS o(so)
        WHERE so = 0 OR r_regionkey = 4
        UNION ALL
        SELECT r_name, 'pia', n_name, 0, vo,
               CAST(CASE WHEN vo = 1 THEN 995 WHEN n_nationkey % 5 = 3 THEN 30 ELSE 2 + n_nationkey % 5 END AS DOUBLE),
               CAST(40*n_nationkey + 10*vo AS DOUBLE)
        FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0),(1)) AS v(vo)
        WHERE n_nationkey <> 7
        UNION ALL
        SELECT r_name, 'wm', n_name, 0, vo, CAST(CASE WHEN vo = 0 THEN 3 ELSE 990 END AS DOUBLE),
               CAST(40*n_nationkey + CASE WHEN vo = 0 THEN 20 WHEN n_nationkey % 9 = 5 THEN 5 ELSE 30 END AS DOUBLE)
        FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES (0),(1)) AS v(vo)
        WHERE n_nationkey % 4 <> 0
        UNION ALL
        SELECT r_name, 'exclusion', n_name, 0, vo, CAST(vx AS DOUBLE),
               CAST(40*n_nationkey + CASE WHEN vo IN (2,3) THEN 18 WHEN n_nationkey % 12 = 0 THEN 2 ELSE 12 END AS DOUBLE)
        FROM nation JOIN region ON n_regionkey = r_regionkey
             CROSS JOIN (VALUES (0,400),(1,420),(2,420),(3,400)) AS v(vo,vx)
        WHERE n_nationkey % 6 = 0""",
    "elements_v": """
        SELECT n_name AS section,
               CASE WHEN s_suppkey % 13 IN (8, 9, 10, 11) THEN 'tables' WHEN s_suppkey % 13 = 12 THEN 'images' ELSE 'shapes' END AS family,
               CASE s_suppkey % 13 WHEN 0 THEN 'MOSAIK_proseg' WHEN 1 THEN 'MOSAIK_cellpose' WHEN 2 THEN 'cell_boundaries'
                    WHEN 3 THEN 'MOSAIK_proseg_v2' WHEN 4 THEN 'table_original' WHEN 5 THEN 'aligned_Cellpose'
                    WHEN 6 THEN '_derived_outline__x__w3' WHEN 7 THEN 'merscope_cell_boundaries'
                    WHEN 8 THEN 'table_MOSAIK_proseg_clustering_squidpy' WHEN 9 THEN 'table_MOSAIK_proseg_mask_counts_clustering_squidpy'
                    WHEN 10 THEN 'table_MOSAIK_cellpose_clustering_squidpy' WHEN 11 THEN 'table_original_clustering_squidpy'
                    ELSE s_name END AS key
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}

_NEEDS = {
    "cell_types_v": ["cell_types_raw_v"],
    "annotated_genes_v": ["transcripts_v", "marker_reference_v"],
    "gene_fg_bg_v": ["transcripts_v"],
    "assigned_v": ["transcripts_v"],
    "int_image_v": ["image_v"],
    "labels_v": ["image_v"],
}


def oracle(body: str, *views: str, **extra: str) -> str:
    """A SELECT over the adapter views it names; ``extra`` adds views of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order] + [f"{name} AS ({sql})" for name, sql in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str, row_key: bool = False) -> DataFrame:
    """One transcript per line item; its gene is the part's name."""
    lines = table(spark, sf_dir, "lineitem")
    key = []
    if row_key:
        lines = lines.withColumns({"source_file": F.col("_metadata.file_path"), "source_row": F.col("_metadata.row_index")})
        key = ["source_file", "source_row"]
    parts = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.when(F.col("p_size") == 13, F.concat(F.lit("Blank-"), name)).otherwise(name).alias("gene"),
        F.expr("CAST((l_orderkey*13 + l_partkey*7) % 1000 AS DOUBLE) + l_quantity / CAST(64 AS DOUBLE)").alias("x"),
        F.expr(
            "CAST((l_partkey*29 + l_suppkey*17 + l_linenumber*101) % 1000 AS DOUBLE)"
            " + CAST(l_linenumber AS DOUBLE) / CAST(16 AS DOUBLE)"
        ).alias("y"),
        F.col("l_suppkey").alias("assignment"),
        (F.col("l_returnflag") == "R").alias("background"),
        F.col("l_linestatus").alias("platform"),
        *key,
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).withColumn("section", F.lit(SECTION))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds and squares with a known inside and area; shape order is the id."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey > 0").select(
        F.col("s_suppkey"),
        "s_nationkey",
        ((F.col("s_suppkey") % 10) * 100 + 50).cast("double").alias("cx"),
        ((F.floor(F.col("s_suppkey") / 10) % 10) * 100 + 50).cast("double").alias("cy"),
        (F.col("s_nationkey") + 40).cast("double").alias("w"),
        (F.col("s_suppkey") % 3 == 0).alias("sq"),
    )

    def ring(*corners: tuple[int, int]) -> str:
        return "array(" + ", ".join(f"named_struct('x', cx + w * {dx}, 'y', cy + w * {dy})" for dx, dy in corners) + ")"

    diamond = ring((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))
    square = ring((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    outer = f"CASE WHEN sq THEN {square} ELSE {diamond} END"
    shaped = s.select(
        F.lit(SECTION).alias("section"),
        F.col("s_suppkey").alias("cell_id"),
        F.col("s_suppkey").alias("shape_ord"),
        F.expr(f"array(named_struct('exterior', {outer}, 'holes', {g.NO_HOLES}))").alias("parts"),
    )
    return scan_cells(shaped)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("label_id"),
        F.col("c_mktsegment").alias("channel"),
        F.lit("mean").alias("statistic"),
        F.when(F.col("c_custkey") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("value"),
    )


def cell_types_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    name = F.col("r_name")
    return joined.select(
        F.col("s_suppkey").cast("string").alias("cell"),
        F.when(name == "EUROPE", "neurons").when(name == "ASIA", "nan").otherwise(name).alias("broad_class"),
        F.when(F.col("s_nationkey") % 7 == 0, "none").otherwise(F.col("n_name")).alias("hierarchical_cluster"),
        F.when(F.col("s_acctbal") > 5000, "Excitatory").when(F.col("s_acctbal") > 2000, "Inhibitory").alias("neuron_split_label"),
    )


def marker_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("gene")).distinct()
    words = F.split("gene", " ")
    return names.select("gene", words[0].alias("broad"), words[1].alias("fine")).filter("broad <> 'hot'")


def _image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    height = e.agg(F.max("vec_id") + 1).scalar()
    return e.select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values"), "label").withColumn("height", height)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster row per embedding."""
    return scan_image(_image_rows(spark, sf_dir), "img", SECTION)


def int_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 1000))


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_image_rows(_image_rows(spark, sf_dir), "img", SECTION)


def image_tiles(spark: SparkSession, sf_dir: str, tile: int) -> DataFrame:
    return scan_image_tiles(_image_rows(spark, sf_dir), "img", SECTION, "float64", tile)


def int_image_tiles(spark: SparkSession, sf_dir: str, tile: int) -> DataFrame:
    rows = _image_rows(spark, sf_dir)
    return scan_image_tiles(rows.withColumn("values", F.transform("values", lambda v: F.floor(v * 1000))), "img", SECTION, "int64", tile)


def label_tiles(spark: SparkSession, sf_dir: str, tile: int) -> DataFrame:
    return scan_image_tiles(_label_rows(spark, sf_dir), "lab", SECTION, "int64", tile)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_labels(_label_rows(spark, sf_dir), "lab", SECTION)


def _label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _image_rows(spark, sf_dir)
    blocks = F.transform("values", lambda _v, i: F.when(F.col("label") == 0, F.lit(0).cast("bigint")).otherwise(
        F.lit(1) + F.floor(F.col("row") / 6) * 11 + F.floor(i / 6)))
    return rows.withColumn("values", blocks)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    kind = F.col("s_suppkey") % 13
    names = (
        "MOSAIK_proseg", "MOSAIK_cellpose", "cell_boundaries", "MOSAIK_proseg_v2", "table_original", "aligned_Cellpose",
        "_derived_outline__x__w3", "merscope_cell_boundaries", "table_MOSAIK_proseg_clustering_squidpy",
        "table_MOSAIK_proseg_mask_counts_clustering_squidpy", "table_MOSAIK_cellpose_clustering_squidpy",
        "table_original_clustering_squidpy",
    )
    key = F.col("s_name")
    for i, name in enumerate(names):
        key = F.when(kind == i, F.lit(name)).otherwise(key)
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("section"),
        F.when(kind.between(8, 11), "tables").when(kind == 12, "images").otherwise("shapes").alias("family"),
        key.alias("key"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per region and one piece per nation; every shape is built from its own row."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)

    def shape(df: DataFrame, role: str, piece, order, *vertices) -> DataFrame:
        made = F.array(*[g.vertex(x if hasattr(x, "cast") else F.lit(x), y if hasattr(y, "cast") else F.lit(y)) for x, y in vertices])
        return df.select(
            F.col("r_name").alias("section"), F.lit(role).alias("role"), piece.alias("tissue_piece_id"),
            order.cast("bigint").alias("shape_ord"), made.alias("vertices"),
        )

    none, zero = F.lit(None).cast("string"), F.lit(0)
    orders = F.when(F.col("r_regionkey") == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    side = shape(r.withColumn("_o", F.explode(orders)), "side", none, F.col("_o"), (0, 1000), (0, 0), (1000, 0), (1000, 1000))
    start = F.when(k % 5 == 3, F.lit(30)).otherwise(k % 5 + 2)
    pia = shape(rows.filter(k != 7), "pia", F.col("n_name"), zero, (start, k * 40), (995, k * 40 + 10))
    end = F.when(k % 9 == 5, F.lit(5)).otherwise(F.lit(30))
    wm = shape(rows.filter(k % 4 != 0), "wm", F.col("n_name"), zero, (3, k * 40 + 20), (990, k * 40 + end))
    low = F.when(k % 12 == 0, F.lit(2)).otherwise(F.lit(12))
    box = shape(
        rows.filter(k % 6 == 0), "exclusion", F.col("n_name"), zero,
        (400, k * 40 + low), (420, k * 40 + low), (420, k * 40 + 18), (400, k * 40 + 18),
    )
    return side.unionByName(pia).unionByName(wm).unionByName(box)
