"""Queries over cell polygons and rasters. Oracles use the closed form of the diamonds and squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import affine
from cytoplane.operators import cells as c
from cytoplane.operators import celltypes as ct
from cytoplane.operators import layout, tiles
from cytoplane.operators import raster as r
from cytoplane.plans import adapters as a
from cytoplane.plans.adapters import SECTION, oracle
from cytoplane.plans.registry import ORACLES, query, scratch
from cytoplane.sources import cells as stored_cells
from cytoplane.sources import tables


def _types(spark, sf):
    return tables.scan_cell_types(a.cell_types_raw(spark, sf))


def _round(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


@query(oracle("""
    SELECT CAST(cell_id AS VARCHAR) AS cell_id, cell_id AS shape_ord, cx - w AS xmin, cy - w AS ymin, cx + w AS xmax, cy + w AS ymax,
           CASE WHEN sq THEN 4*w*w ELSE 2*w*w END AS area FROM cells_v""", "cells_v"))
def scan_cells(spark, sf):
    return a.cells(spark, sf).select("cell_id", "shape_ord", "xmin", "ymin", "xmax", "ymax", "area")


@query(oracle("SELECT 'c0' AS channel, r AS row, CAST(c AS BIGINT) AS col, value, h AS height, CAST(w AS BIGINT) AS width FROM image_v, raster_size_v", "image_v", "raster_size_v"))
def scan_image(spark, sf):
    return a.image(spark, sf).drop("section", "key")


@query(oracle("SELECT r AS row, CAST(c AS BIGINT) AS col, CAST(value AS BIGINT) AS value FROM labels_v", "labels_v"))
def scan_labels(spark, sf):
    return a.labels(spark, sf).select("row", "col", "value")


# A box that cuts through several cells.
_BOX = (130.5, 260.25, 420.0, 505.5)


@query(oracle(f"""
    SELECT CAST(cell_id AS VARCHAR) AS cell_id FROM
      (SELECT *, greatest({_BOX[0]} - cx, cx - {_BOX[2]}, 0) AS dx, greatest({_BOX[1]} - cy, cy - {_BOX[3]}, 0) AS dy FROM cells_v) AS q
    WHERE CASE WHEN sq THEN greatest(dx, dy) <= w ELSE dx + dy <= w END""", "cells_v"))
def cells_in_bbox(spark, sf):
    return c.cells_in_bbox(a.cells(spark, sf), *_BOX).select("cell_id")


_IN_BOX = ORACLES["cells_in_bbox"]


@query(_IN_BOX)
def cells_in_bbox_stored(spark, sf):
    """The same from cells stored along a Hilbert curve."""
    path = scratch(spark, "hilbert-cells")
    layout.write_cells(a.cells(spark, sf), path, 1 << 16)
    return c.cells_in_bbox(spark.read.parquet(path), *_BOX).select("cell_id")


_LOCATED = """
    SELECT p.x, p.y, p.n, arg_min(CAST(cell_id AS VARCHAR), (CASE WHEN sq THEN 4*w*w ELSE 2*w*w END, cell_id)) AS cell_id
    FROM (SELECT x, y, count(*) AS n FROM transcripts_v GROUP BY x, y) AS p
    LEFT JOIN cells_v AS k ON CASE WHEN sq THEN greatest(abs(p.x - cx), abs(p.y - cy)) < w ELSE abs(p.x - cx) + abs(p.y - cy) < w END
    GROUP BY p.x, p.y, p.n"""


@query(oracle(_LOCATED, "transcripts_v", "cells_v"))
def locate_cell(spark, sf):
    return _by_place(c.locate_cell(a.points(spark, sf).select("section", "x", "y"), a.cells(spark, sf)))


def _by_place(located):
    """Points at the same place are in the same cell."""
    rest = [x for x in located.columns if x not in ("section", "x", "y")]
    return located.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), *(F.min(x).alias(x) for x in rest))


@query(oracle(f"""
    SELECT p.gene, p.x, p.y, p.background, l.cell_id FROM transcripts_v AS p JOIN ({_LOCATED}) AS l ON l.x = p.x AND l.y = p.y""", "transcripts_v", "cells_v"))
def locate_points(spark, sf):
    """Every point as a row of its own, with what it carries."""
    return c.locate_cell(a.points(spark, sf).select("section", "gene", "x", "y", "background"), a.cells(spark, sf)).drop("section")


@query(oracle(f"""
    SELECT x, y, n, l.cell_id, coalesce(broad, 'Unannotated') AS broad, coalesce(fine, 'Unannotated') AS fine
    FROM ({_LOCATED}) AS l LEFT JOIN cell_types_v AS t ON CAST(t.cell_id AS VARCHAR) = l.cell_id""", "transcripts_v", "cells_v", "cell_types_v"))
def locate_and_annotate(spark, sf):
    return _by_place(c.locate_and_annotate(a.points(spark, sf).select("section", "x", "y"), a.cells(spark, sf), _types(spark, sf)))


# Two microns per pixel, origin at -10: 550 x 600 pixels in tiles of 64.
_T2 = dict(a=2.0, c=-10.0, e=2.0, f=-10.0)


@query(oracle("""
    SELECT CAST(cell_id AS VARCHAR) AS cell_id, CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx FROM
      (SELECT *, greatest(x0 - cx, cx - x1, 0) AS dx, greatest(y0 - cy, cy - y1, 0) AS dy FROM
        (SELECT k.*, ty, tx, 128*tx - 10 AS x0, 2*least(64*tx + 64, 600) - 10 AS x1, 128*ty - 10 AS y0, 2*least(64*ty + 64, 550) - 10 AS y1
         FROM cells_v AS k, generate_series(0, 8) AS gy(ty), generate_series(0, 9) AS gx(tx)) AS p) AS q
    WHERE CASE WHEN sq THEN greatest(dx, dy) <= w ELSE dx + dy <= w END""", "cells_v"))
def tile_candidates(spark, sf):
    found = c.tile_candidates(a.cells(spark, sf), 550, 600, affine.literal(**_T2), tile=64)
    return found.select("cell_id", "ty", "tx")


@query(oracle("""
    SELECT r AS row, CAST(c AS BIGINT) AS col, CAST(l.value AS BIGINT) AS value, b.bin FROM labels_v AS l LEFT JOIN
      (SELECT label_id, CAST(floor(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) AS BIGINT) AS bin
       FROM features_v, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM features_v WHERE NOT isnan(value)) AS q
       WHERE NOT isnan(value) AND label_id > 0) AS b ON b.label_id = l.value""", "labels_v", "features_v"))
def value_overlay(spark, sf):
    values = a.features(spark, sf)
    bins = ct.binned_values(values, ct.value_clip_range(values))
    overlay = r.value_overlay(a.label_tiles(spark, sf, 48), bins)
    return tiles.unpack_overlay(overlay, "bin", 48).select("row", "col", "value", "bin")


@query(oracle("""
    SELECT r AS row, CAST(c AS BIGINT) AS col, CAST(l.value AS BIGINT) AS value, t.broad AS cell_type
    FROM labels_v AS l LEFT JOIN cell_types_v AS t ON t.cell_id = CAST(l.value AS BIGINT) AND l.value <> 0 AND length(broad) % 2 = 0""", "labels_v", "cell_types_v"))
def cell_type_overlay(spark, sf):
    types = _types(spark, sf)
    on = types.select(F.col("broad").alias("label")).filter(F.length("label") % 2 == 0)
    overlay = r.cell_type_overlay(a.label_tiles(spark, sf, 48), ct.enabled_cell_types(types, on))
    return tiles.unpack_overlay(overlay, "cell_type", 48).select("row", "col", "value", "cell_type")


@query(oracle("""
    SELECT a.cell_id, gene, x AS x1, y AS y1, cx AS x2, cy AS y2 FROM assigned_v AS a
    JOIN cells_v AS k ON CAST(k.cell_id AS VARCHAR) = a.cell_id WHERE s_nationkey = 3""", "assigned_v", "cells_v"))
def transcript_links(spark, sf):
    chosen = a.table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("cell_id"))
    picked = a.cells(spark, sf).join(chosen, "cell_id", "left_semi")
    return _round(c.transcript_links(a.transcripts(spark, sf), picked), "x2", "y2")


@query(oracle("SELECT CAST(cell_id AS VARCHAR) AS cell_id, CASE WHEN sq THEN 4*w*w ELSE 2*w*w END AS area, cx, cy FROM cells_v", "cells_v"))
def cell_geometry(spark, sf):
    return _round(c.cell_geometry(a.cells(spark, sf).drop("area")), "area", "cx", "cy").select("cell_id", "area", "cx", "cy")


# The image laid over the cells: 16 microns per column and 2 per row.
_T16 = dict(a=16.0, e=2.0)
_INTENSITY = """
    SELECT CAST(cell_id AS VARCHAR) AS cell_id, 'c0' AS channel, round(avg(value), 6) AS mean, count(value) AS n
    FROM cells_v AS k LEFT JOIN image_v AS i
      ON CASE WHEN sq THEN greatest(abs(c*16 - cx), abs(r*2 - cy)) <= w ELSE abs(c*16 - cx) + abs(r*2 - cy) <= w END
    GROUP BY cell_id"""


def _intensity(spark, sf):
    image = a.image_tiles(spark, sf, 128)
    height = a.table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).scalar()
    channels = a.image_rows(spark, sf).select("section", "key", "channel")
    return c_i(a.cells(spark, sf), image, height, 64, affine.literal(**_T16), 128, channels)


c_i = r.cell_channel_intensity


@query(oracle(_INTENSITY, "cells_v", "image_v"))
def cell_channel_intensity(spark, sf):
    return _round(_intensity(spark, sf), "mean").select("cell_id", "channel", "mean", "n")


@query(oracle(f"""
    SELECT CAST(k.cell_id AS VARCHAR) AS cell_id, CASE WHEN sq THEN 4*w*w ELSE 2*w*w END AS area, cx, cy, coalesce(g.total, 0) AS total,
           coalesce(g.genes, '') AS genes, i.mean AS intensity, coalesce(broad, 'Unannotated') AS broad, coalesce(fine, 'Unannotated') AS fine
    FROM cells_v AS k
    LEFT JOIN (SELECT cell_id, CAST(sum(n) AS BIGINT) AS total, string_agg(gene || ':' || n, '|' ORDER BY n DESC, gene) AS genes
               FROM (SELECT cell_id, gene, count(*) AS n FROM assigned_v GROUP BY ALL) AS q GROUP BY cell_id) AS g ON g.cell_id = CAST(k.cell_id AS VARCHAR)
    LEFT JOIN ({_INTENSITY}) AS i ON i.cell_id = CAST(k.cell_id AS VARCHAR)
    LEFT JOIN cell_types_v AS t ON t.cell_id = k.cell_id""", "cells_v", "assigned_v", "cell_types_v", "image_v"))
def cell_summary(spark, sf):
    rows = c.cell_summary(a.cells(spark, sf), a.transcripts(spark, sf), _intensity(spark, sf), _types(spark, sf))
    genes = F.array_join(F.transform("genes", lambda g: F.concat(g["gene"], F.lit(":"), g["n"].cast("string"))), "|")
    flat = rows.withColumn("genes", F.coalesce(genes, F.lit(""))).withColumn("intensity", F.col("channels")[0]["mean"])
    return _round(flat.drop("channels", "section"), "area", "cx", "cy", "intensity")


@query(oracle("""
    SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, max(cell_id) AS value FROM cells_v, generate_series(0, 127) AS gr(r), generate_series(0, 127) AS gc(c)
    WHERE CASE WHEN sq THEN greatest(abs(c*8 - cx), abs(r*8 - cy)) <= w ELSE abs(c*8 - cx) + abs(r*8 - cy) <= w END GROUP BY ALL""", "cells_v"))
def rasterize_cells(spark, sf):
    shapes = a.cells(spark, sf).withColumn("label_id", F.col("shape_ord"))
    return r.rasterize_cells(shapes, 128, 128, affine.literal(a=8.0, e=8.0), tile=48).drop("section")


_OUTLINE = """
    SELECT o.r, o.c FROM labels_v AS o
    LEFT JOIN labels_v AS u ON u.r = o.r - 1 AND u.c = o.c LEFT JOIN labels_v AS d ON d.r = o.r + 1 AND d.c = o.c
    LEFT JOIN labels_v AS l ON l.r = o.r AND l.c = o.c - 1 LEFT JOIN labels_v AS t ON t.r = o.r AND t.c = o.c + 1
    WHERE o.value <> 0 AND (coalesce(u.value, {0}) <> o.value OR coalesce(d.value, {0}) <> o.value
                            OR coalesce(l.value, {0}) <> o.value OR coalesce(t.value, {0}) <> o.value)"""


@query(oracle("SELECT r AS row, CAST(c AS BIGINT) AS col FROM (" + _OUTLINE.format("0") + ") AS q", "labels_v"))
def outline_mask(spark, sf):
    return r.outline_mask(a.labels(spark, sf)).select("row", "col")


@query(oracle("SELECT r AS row, CAST(c AS BIGINT) AS col FROM (" + _OUTLINE.format("o.value") + ") AS q", "labels_v"))
def outline_mask_unpadded(spark, sf):
    return r.outline_mask(a.labels(spark, sf), pad=False).select("row", "col")


@query(oracle("""
    SELECT DISTINCT i.r AS row, CAST(i.c AS BIGINT) AS col FROM outline_v AS o JOIN labels_v AS i ON abs(i.r - o.r) + abs(i.c - o.c) <= 2
       AND i.r BETWEEN o.r - 2 AND o.r + 2""", "labels_v", outline_v=_OUTLINE.format("0")))
def outline_mask_wide(spark, sf):
    mask = tiles.outline_tiles(a.label_tiles(spark, sf, 48), 3, 48)
    return tiles.unpack_tiles(mask, "bigint", 48, keep_zero=False).select("row", "col")


@query(oracle("SELECT r AS row, CAST(c AS BIGINT) AS col, 1 AS on_tiles FROM (" + _OUTLINE.format("0") + ") AS q", "labels_v"))
def outline_tiles(spark, sf):
    """The tile form of the outline, with a halo between tiles."""
    packed = a.label_tiles(spark, sf, 48)
    mask = tiles.unpack_tiles(tiles.outline_tiles(packed, 1, 48), "bigint", 48, keep_zero=False)
    return mask.select("row", "col", F.lit(1).alias("on_tiles"))


def _subsample_sql(levels: int, least: int) -> str:
    parts = ["SELECT 0 AS level, r AS row, c AS col, value FROM image_v"]
    for k in range(1, levels):
        # The level before still has a side above the limit.
        parts.append(f"""SELECT {k}, CAST(floor(r / {1 << k}) AS BIGINT), CAST(floor(c / {1 << k}) AS BIGINT), value FROM image_v, raster_size_v
            WHERE r % {1 << k} = 0 AND c % {1 << k} = 0 AND greatest(ceil(h / {1 << (k - 1)}), ceil(w / {1 << (k - 1)})) > {least}""")
    return "SELECT CAST(level AS BIGINT) AS level, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, value FROM (" + " UNION ALL ".join(parts) + ") AS q"


@query(oracle(_subsample_sql(10, 8), "image_v", "raster_size_v"))
def subsample_pyramid(spark, sf):
    return r.subsample_pyramid(a.image(spark, sf), min_size=8).select("level", "row", "col", "value")


def _chain_sql(base: str, value: str, step: int, least: int, levels: int, first: int = 1) -> dict[str, str]:
    """One view per level, each from the one before, with the stop rule and trimmed borders."""
    views = {"level_0": base}
    for k in range(1, levels + 1):
        views[f"level_{k}"] = f"""SELECT CAST(floor(r / {step}) AS BIGINT) AS r, CAST(floor(c / {step}) AS BIGINT) AS c, {value} AS value,
              CAST(floor(h / {step}) AS BIGINT) AS h, CAST(floor(w / {step}) AS BIGINT) AS w FROM level_{k - 1}
            WHERE greatest(h, w) > {least} AND least(h, w) >= {step} AND r < floor(h / {step}) * {step} AND c < floor(w / {step}) * {step} GROUP BY ALL"""
    return views


def _levels(count: int, start: int = 1) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS level, r AS row, CAST(c AS BIGINT) AS col, value FROM level_{k}" for k in range(start, count + 1))


_INT_BASE = "SELECT r, c, value, h, w FROM int_image_v, raster_size_v"
_ROUND = "CAST(round_even(avg(value), 0) AS BIGINT)"


@query(oracle(_levels(7), "int_image_v", "raster_size_v", **_chain_sql(_INT_BASE, _ROUND, 2, 8, 7)))
def mean_pyramid(spark, sf):
    return r.mean_pyramid(a.int_image(spark, sf), step=2, min_size=8, max_levels=7).select("level", "row", "col", "value")


_LABEL_BASE = "SELECT r, c, CAST(value AS BIGINT) AS value, h, w FROM labels_v, raster_size_v"


@query(oracle(_levels(6, 0), "labels_v", "raster_size_v", **_chain_sql(_LABEL_BASE, "max(value)", 2, 8, 6)))
def max_pyramid(spark, sf):
    base = a.label_tiles(spark, sf, 64)
    levels = base.unionByName(tiles.tile_pyramid(base, 2, "max", 8, 6, 64))
    return tiles.unpack_tiles(levels, "bigint", 64).select("level", "row", "col", "value")


@query(oracle("SELECT * FROM (" + _levels(4, 0) + ") AS q WHERE value > 0", "labels_v", "raster_size_v", outline_v=_OUTLINE.format("0"),
              **_chain_sql("SELECT l.r, l.c, CASE WHEN o.r IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(255 AS BIGINT) END AS value, h, w "
                           "FROM raster_size_v, labels_v AS l LEFT JOIN outline_v AS o ON o.r = l.r AND o.c = l.c", _ROUND, 2, 8, 4)))
def outline_coverage_pyramid(spark, sf):
    levels = r.tile_coverage(a.label_tiles(spark, sf, 64), min_size=8, max_levels=5, tile=64)
    return tiles.unpack_tiles(levels, "bigint", 64, keep_zero=False).select("level", "row", "col", "value")


@query(oracle("SELECT level, row, col, round(value, 4) AS value FROM (" + _levels(5, 0) + ") AS q WHERE value > 0", "transcripts_v",
              binned_v="SELECT CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c, count(*) AS n FROM transcripts_v GROUP BY ALL",
              **_chain_sql("""SELECT CAST(gr.r AS BIGINT) AS r, CAST(gc.c AS BIGINT) AS c, CAST(coalesce(n, 0) AS DOUBLE) AS value, 101 AS h, 101 AS w
                           FROM generate_series(0, 100) AS gr(r) CROSS JOIN generate_series(0, 100) AS gc(c) LEFT JOIN binned_v AS b ON b.r = gr.r AND b.c = gc.c""",
                           "avg(value)", 2, 4, 5)))
def density_pyramid(spark, sf):
    grid = r.density_grid(a.points(spark, sf), 10.0)
    out = r.density_pyramid(grid, 101, 101, min_size=4, max_levels=6)
    return out.select("level", "row", "col", F.round(F.col("value").cast("double"), 4).alias("value"))


@query(oracle(_levels(5, 0), "int_image_v", "raster_size_v", **_chain_sql(_INT_BASE, _ROUND, 2, 16, 5)))
def complete_pyramid(spark, sf):
    """A stored pyramid of two levels, extended from its second one."""
    base = a.int_image_tiles(spark, sf, 64)
    stored = base.unionByName(tiles.tile_pyramid(base, 2, "mean", 16, 1, 64))
    return tiles.unpack_tiles(r.complete_tiles(stored, 16, 6, 64), "bigint", 64).select("level", "row", "col", "value")


@query(oracle("SELECT level, row, col, value FROM (" + _levels(2) + ") AS q WHERE level = 2", "int_image_v", "raster_size_v", **_chain_sql(_INT_BASE, _ROUND, 2, 8, 2)))
def scan_image_level(spark, sf):
    """Of three stored levels the coarsest with at most five finest pixels a pixel."""
    path = scratch(spark, "image-levels")
    base = a.int_image_tiles(spark, sf, 64)
    coarse = tiles.tile_pyramid(base, 2, "mean", 8, 2, 64)
    named = {"scale10": coarse.filter("level = 2"), "scale2": coarse.filter("level = 1"), "scale0": base}
    stored_cells.write_image_levels(named, path)
    chosen = stored_cells.scan_image_level(spark, path, SECTION, "img", 5)
    return tiles.unpack_tiles(chosen, "bigint", 64).select("level", "row", "col", "value")


@query(oracle("SELECT r AS row, CAST(c AS BIGINT) AS col, value, CAST(floor(r / 48) AS BIGINT) AS ty, CAST(floor(c / 48) AS BIGINT) AS tx FROM int_image_v", "int_image_v"))
def retile(spark, sf):
    """Tiles of 20 merged and cut to tiles of 48; the pixels must stay where they are."""
    packed = a.int_image_tiles(spark, sf, 20)
    pixels = tiles.unpack_tiles(tiles.retile(packed, 20, 48), "bigint", 48)
    return pixels.select("row", "col", "value", F.floor(F.col("row") / 48).alias("ty"), F.floor(F.col("col") / 48).alias("tx"))


@query(oracle("SELECT level, row, col, value FROM (" + _levels(2) + ") AS q", "int_image_v", "raster_size_v", **_chain_sql(_INT_BASE, _ROUND, 2, 8, 2)))
def mean_pyramid_tiles(spark, sf):
    """The tile form of the mean pyramid: two levels without a shuffle between them."""
    one = tiles.reduce_tiles(a.int_image_tiles(spark, sf, 48), 2, "mean", 48)
    two = tiles.reduce_tiles(one, 2, "mean", 24)
    out = tiles.unpack_tiles(one, "bigint", 24).unionByName(tiles.unpack_tiles(two, "bigint", 12))
    return out.select("level", "row", "col", "value")
