"""Cell polygons: geometry, location of points, raster tiles, intensities and the cell summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cytoplane.functions import affine
from cytoplane.functions import geometry as g
from cytoplane.operators import celltypes
from cytoplane.operators.grid import _level, common_levels, split_hot
from cytoplane.operators.transcripts import assigned_points, cell_gene_counts, cell_key, ranked_genes
from cytoplane.session import materialize

TILE = 1024
#: Meetings of an edge and a point that are judged at once.
MEETINGS = 2_000_000
#: Meetings a point, on average, and owners that are judged before points that are found leave.
ROUND, OWNERS = 8, 4096


def with_bounds(cells: DataFrame) -> DataFrame:
    """Add the bounding box of ``parts``."""
    return cells.withColumns(g.bounds(g.exterior_vertices("parts")))


def cell_geometry(cells: DataFrame) -> DataFrame:
    """Area and centroid of each (multi)polygon, holes subtracted."""
    return cells.withColumn("_m", F.expr(g.polygon_measures("parts"))).select(
        *cells.columns, F.col("_m.area").alias("area"), F.col("_m.cx").alias("cx"), F.col("_m.cy").alias("cy")
    )


def cells_in_bbox(cells: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells that share a point with a box.

    The box test on the stored bounds is a plain comparison and is pushed to the Parquet scan; the
    polygon test sees only what is left.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) for v in (xmin, ymin, xmax, ymax))
    near = cells.filter((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    edged = near.withColumns({"_edges": F.expr(g.edges_of_parts("parts")), "_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1})
    return edged.filter(F.expr(g.polygon_meets_box("_edges", "_x0", "_y0", "_x1", "_y1"))).select(*cells.columns)


def _edges_at(rows: str, box: str) -> str:
    """Edges of a polygon that a ray to the right from a grid cell can meet, as one flat list of numbers."""
    kept = (
        f"filter(_edges, ke -> floor(least(ke.y1, ke.y2) / {box}) <= {rows} AND floor(greatest(ke.y1, ke.y2) / {box}) >= {rows} "
        f"AND floor(greatest(ke.x1, ke.x2) / {box}) >= _gx)"
    )
    return f"flatten(transform({kept}, kf -> array(kf.x1, kf.y1, kf.x2, kf.y2)))"


def inside_cells(x: np.ndarray, y: np.ndarray, edges: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each point the owner of lowest rank whose edges (n x 4) surround it strictly, or -1.

    Points are sorted by y, so that bisection gives the slab of points which an edge spans. Each meeting of an edge and a
    point of its slab is judged by products only: on the edge, or left of it. Owners are settled by parity.
    """
    alive = np.argsort(y, kind="stable")
    ys = y[alive]
    x1, y1, x2, y2 = edges.T
    low_y, high_y = np.minimum(y1, y2), np.maximum(y1, y2)
    best = np.full(len(x), len(rank), dtype=np.int64)
    place = np.empty(len(rank), dtype=np.int64)
    place[np.argsort(rank, kind="stable")] = np.arange(len(rank))
    # Owners in order of rank, as many at a time as give a bounded number of meetings. A point that one of them holds
    # meets no more, as those that follow rank behind it.
    by_rank = np.argsort(place[owner], kind="stable")
    last_of = np.flatnonzero(np.diff(owner[by_rank], append=-1) != 0) + 1
    at = 0
    while at < len(by_rank) and len(alive):
        # Edges that are looked at; at least one owner, and never one cut in two.
        to = int(last_of[min(np.searchsorted(last_of, at, side="right") + OWNERS, len(last_of)) - 1])
        some = by_rank[at:to]
        first = np.searchsorted(ys, low_y[some], side="left")
        n = np.searchsorted(ys, high_y[some], side="right") - first
        ends = np.cumsum(n)
        fit = int(np.searchsorted(ends, min(MEETINGS, max(ROUND * len(alive), MEETINGS // 16)), side="right"))
        to = min(to, int(last_of[np.searchsorted(last_of, at + max(fit, 1), side="left")]))
        mine, n, first = by_rank[at:to], n[: to - at], first[: to - at]
        at = to
        e = np.repeat(mine, n)
        p = alive[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        px, py = x[p], y[p]
        near = px <= np.maximum(x1[e], x2[e])
        e, p, px, py = e[near], p[near], px[near], py[near]
        cross = (x2[e] - x1[e]) * (py - y1[e]) - (px - x1[e]) * (y2[e] - y1[e])
        on = (cross == 0) & (px >= np.minimum(x1[e], x2[e]))
        hit = ((y1[e] > py) != (y2[e] > py)) & ((cross > 0) == (y2[e] > y1[e])) & ~on
        low = place[owner[mine[0]]]
        width = int(place[owner[mine[-1]]]) - int(low) + 1
        slot = p * width + (place[owner[e]] - low)
        odd, seen = np.unique(slot[hit], return_counts=True)
        odd = np.setdiff1d(odd[seen % 2 == 1], slot[on], assume_unique=False)
        if len(odd):
            np.minimum.at(best, odd // width, odd % width + low)
            left = best[alive] == len(rank)
            alive, ys = alive[left], ys[left]
    back = np.append(np.argsort(place, kind="stable"), -1)
    return back[best]


def _first_of_equals(cells: DataFrame, on: list[str]) -> DataFrame:
    """Of cells with the same polygon the one that a point in it belongs to."""
    alike = [*on, "parts", "area", "xmin", "ymin", "xmax", "ymax"]
    first = F.min(F.struct("shape_ord", F.col("cell_id").cast("string").alias("cell_id"))).alias("_first")
    return cells.groupBy(*alike).agg(first).select(*alike, "_first.*")


def locate_cell(points: DataFrame, cells: DataFrame, row_key: list[str] | None = None) -> DataFrame:
    """Every point with the cell that strictly contains it, or null: the columns of ``points`` and ``cell_id``.

    Where masks overlap the smallest area wins, then the lowest ``shape_ord``. ``cells`` carries bounds and area; with a
    ``seg_key`` a point has one row per segmentation of its section. Points meet edges in grid cells: a point in one
    for each level in use (most often one), an edge only in those where a ray to the right can meet it. Crowded grid
    cells are split. ``row_key`` names columns that tell points apart; without it points are numbered where several
    levels are in use, which stores them once. Nulls and NaN lie in no cell. Of equal polygons only the first is sent.
    """
    on = ["section", *(c for c in ("seg_key",) if c in cells.columns)]
    cells = _first_of_equals(cells, on)
    base, levels = common_levels(cells)
    several = len(levels) > 1
    names = points.columns
    if several and row_key is None:
        points, row_key = materialize(points.withColumn("_row", F.monotonically_increasing_id())), ["_row"]
    side = F.pow(F.lit(2.0), F.col("_level"))
    keys = [*on, "_level", "_gx", "_gy"]
    asked = points if len(on) == 1 else points.join(materialize(cells.select(*on).distinct()), "section", "left")
    each = F.explode(F.array(*map(F.lit, levels))) if several else F.lit(levels[0])
    placed = asked.withColumn("_level", each).withColumns({"_gx": F.floor(F.col("x") / side), "_gy": F.floor(F.col("y") / side)})
    own = _level(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    homes = cells.withColumn("_level", F.greatest(own, F.lit(base)))
    spread = homes.withColumn("_edges", F.expr(g.edges_of_parts("parts"))).withColumn("_side", side)
    for axis in ("x", "y"):
        spread = spread.withColumn(f"_g{axis}", F.explode(F.sequence(F.floor(F.col(f"{axis}min") / side), F.floor(F.col(f"{axis}max") / side))))
    routed = spread.select(*keys, F.col("cell_id").cast("string").alias("cell_id"), "shape_ord", "area", F.expr(_edges_at("_gy", "_side")).alias("_edges"))
    dealt, copied = split_hot(placed, routed.filter(F.size("_edges") > 0), keys, F.xxhash64(*row_key) if row_key else None, guess=F.xxhash64("x", "y"))
    out_names = [*points.columns, *on[1:]]
    schema = StructType([dealt.schema[c] for c in out_names]).add("cell_id", "string").add("_area", "double").add("_ord", "long")
    types = to_arrow_schema(schema)

    def look_up(mine: pa.Table, shapes: pa.Table) -> pa.Table:
        found = np.full(mine.num_rows, -1)
        if shapes.num_rows and mine.num_rows:
            lists = shapes.column("_edges").combine_chunks()
            edges = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            owner = np.repeat(np.arange(shapes.num_rows), np.diff(lists.offsets.to_numpy()) // 4)
            area, order = (shapes.column(c).to_numpy() for c in ("area", "shape_ord"))
            rank = np.empty(shapes.num_rows, dtype=np.int64)
            rank[np.lexsort((shapes.column("cell_id").to_numpy(zero_copy_only=False).astype(str), order, area))] = np.arange(shapes.num_rows)
            x, y = (mine.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
            found = inside_cells(x, y, edges, owner, rank)
        take = pa.array(found, mask=found < 0)
        told = [shapes.column(c).combine_chunks().take(take) for c in ("cell_id", "area", "shape_ord")]
        return pa.table([*(mine.column(c) for c in out_names), *told], names=types.names).cast(types)

    dealt = dealt.select(*points.columns, *on[1:], "_level", "_gx", "_gy", "_salt")
    group = [*keys, "_salt"]
    met = dealt.groupBy(*group).cogroup(copied.groupBy(*group)).applyInArrow(look_up, schema)
    if not several:
        return met.drop("_area", "_ord")
    best = F.min(F.when(F.col("cell_id").isNotNull(), F.struct("_area", "_ord", "cell_id"))).alias("_best")
    rest = [c for c in names if c not in row_key]
    one = met.groupBy(*row_key, *on[1:]).agg(best, *(F.first(c).alias(c) for c in rest))
    return one.select(*names, *on[1:], F.col("_best.cell_id").alias("cell_id"))


def locate_and_annotate(points: DataFrame, cells: DataFrame, types: DataFrame) -> DataFrame:
    """Points with their cell and its broad and fine label."""
    return celltypes.annotate_cells(locate_cell(points, cells), types)


def tile_candidates(
    cells: DataFrame,
    height: Column | int,
    width: Column | int,
    transform: dict[str, Column],
    tile: int = TILE,
    exact: bool = True,
) -> DataFrame:
    """Cells that meet the micron window of each raster tile: one row per (cell, tile).

    The candidate tiles follow from the cell's own bounds, so nothing is joined; a tile without cells
    never appears. ``transform`` maps (col, row) to microns, by literals or by columns of ``cells``.
    """
    kept = tile_windows(cells, height, width, transform, tile)
    if exact:
        edged = kept.withColumn("_edges", F.expr(g.edges_of_parts("parts")))
        kept = edged.filter(F.expr(g.polygon_meets_box("_edges", "_window.xmin", "_window.ymin", "_window.xmax", "_window.ymax")))
    return kept.select(*cells.columns, "ty", "tx")


def tile_windows(cells: DataFrame, height: Column | int, width: Column | int, transform: dict[str, Column], tile: int) -> DataFrame:
    """Cells and the tiles that their bounding box meets, with ``_h``, ``_w``, the tile's ``_window`` in microns and the
    inverse transform ``_inv``.

    Both transforms are columns before they are used, so that their expressions are not repeated for every corner.
    """
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
    moved = cells.withColumns({
        "_h": h.cast("bigint"),
        "_w": w.cast("bigint"),
        "_inv": F.struct(*(v.alias(k) for k, v in affine.invert(transform).items())),
        "_fwd": F.struct(*(v.alias(k) for k, v in transform.items())),
    })
    box = "transform(array(named_struct('x', xmin, 'y', ymin), named_struct('x', xmin, 'y', ymax), named_struct('x', xmax, 'y', ymin), named_struct('x', xmax, 'y', ymax))"
    # A rotated tile has a wider micron window than itself; widen the pixel range by the difference.
    half = tile / 2
    reach_x, reach_y = f"{half}D * (abs(_fwd.a) + abs(_fwd.b))", f"{half}D * (abs(_fwd.d) + abs(_fwd.e))"
    for axis, (p, q, r), size in (("y", "def", "_h"), ("x", "abc", "_w")):
        at = f"{box}, v -> _inv.{p} * v.x + _inv.{q} * v.y + _inv.{r})"
        slack = f"abs(_inv.{p}) * {reach_x} + abs(_inv.{q}) * {reach_y} - {half}D"
        # One pixel of slack: a window that only touches its neighbour still meets the cell.
        moved = moved.withColumn("_at", F.expr(at)).withColumn("_slack", F.expr(slack)).withColumn("_span", F.expr(
            f"struct(greatest(floor((array_min(_at) - _slack - 1) / {tile}), 0L) AS a, "
            f"least(floor((array_max(_at) + _slack + 1) / {tile}), ceil({size} / {tile}) - 1) AS b)"))
        moved = moved.withColumn(f"t{axis}", F.explode(F.expr(
            "CASE WHEN _span.a <= _span.b THEN sequence(_span.a, _span.b) ELSE cast(array() AS array<bigint>) END")))
    corners = F.expr(
        f"transform(array(struct(ty * {tile} AS r, tx * {tile} AS c), struct(ty * {tile} AS r, least((tx + 1) * {tile}, _w) AS c), "
        f"struct(least((ty + 1) * {tile}, _h) AS r, tx * {tile} AS c), struct(least((ty + 1) * {tile}, _h) AS r, least((tx + 1) * {tile}, _w) AS c)), "
        "p -> struct(_fwd.a * p.c + _fwd.b * p.r + _fwd.c AS x, _fwd.d * p.c + _fwd.e * p.r + _fwd.f AS y))")
    window = F.expr(
        "struct(array_min(transform(_corners, p -> p.x)) AS xmin, array_min(transform(_corners, p -> p.y)) AS ymin, "
        "array_max(transform(_corners, p -> p.x)) AS xmax, array_max(transform(_corners, p -> p.y)) AS ymax)")
    seen = moved.withColumn("_corners", corners).withColumn("_window", window)
    return seen.filter("xmin <= _window.xmax AND xmax >= _window.xmin AND ymin <= _window.ymax AND ymax >= _window.ymin")


def transcript_links(points: DataFrame, cells: DataFrame, exact: bool = True) -> DataFrame:
    """A segment from each transcript of the given cells to the cell's centroid."""
    kept = assigned_points(points, exact)
    key = cell_key(kept, cells)
    centres = cell_geometry(cells).select(*key, "cx", "cy")
    return kept.join(centres, key).select(
        *key, "gene", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("cx").alias("x2"), F.col("cy").alias("y2")
    )


def cell_summary(
    cells: DataFrame, points: DataFrame, intensities: DataFrame, types: DataFrame, exact: bool = True
) -> DataFrame:
    """One row per cell: total, area, centroid, ranked genes, channel means, broad and fine label.

    The lists hold one entry per gene of the panel or per channel, never per transcript.
    """
    ranked = ranked_genes(cell_gene_counts(points, exact))
    by_gene, by_channel = cell_key(ranked, cells), cell_key(intensities, cells)
    genes = ranked.groupBy(*by_gene).agg(
        F.sum("n").alias("total"),
        F.sort_array(F.collect_list(F.struct("rank", "gene", "n"))).alias("genes"),
    )
    # An image's key, where there is one, stands before its channel.
    told = [c for c in ("key", "channel", "mean") if c in intensities.columns]
    channels = intensities.groupBy(*by_channel).agg(F.sort_array(F.collect_list(F.struct(*told))).alias("channels"))
    measured = cell_geometry(cells.drop("area")).select(*cell_key(cells), "area", "cx", "cy")
    joined = measured.join(genes, by_gene, "left").join(channels, by_channel, "left")
    return celltypes.annotate_cells(joined.fillna(0, ["total"]), types, exact)
