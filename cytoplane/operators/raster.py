"""Rasters as pixel rows, and cells as rasters.

``pixels(section, key, channel, row, col, value, height, width)``: height and width are those of the
whole raster and repeat on each row, so that no operator needs a join to know its limits. All
operators work on any number of rasters at once and keep the group columns they find. Whatever looks at neighbours or
draws cells works on runs and on tiles (:mod:`cytoplane.operators.tiles`); its pixel form packs and unpacks them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.operators import tiles
from cytoplane.operators.cells import TILE, tile_windows
from cytoplane.operators.grid import split_hot
from cytoplane.operators.tiles import MAX_LEVELS, MIN_SIZE
from cytoplane.operators.tiles import levels_needed as levels_needed
from cytoplane.session import materialize

# Fixed value: the largest outline coverage.
COVERAGE = 255

#: How pixel values are stored in tiles.
_STORED_AS = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "float64", "float": "float32"}

_PLACE = ("row", "col", "value", "height", "width", "level")


def _group(pixels: DataFrame) -> list[str]:
    return [c for c in pixels.columns if c not in _PLACE]


def _reduce(pixels: DataFrame, step: int, how: str, min_size: int, whole: bool) -> DataFrame:
    """One coarser level. Rasters already small enough, or narrower than a step, stop here."""
    live = pixels.filter(
        (F.greatest("height", "width") > min_size) & (F.least("height", "width") >= step)
        # Trailing rows and columns that do not fill a block are left out.
        & (F.col("row") < F.floor(F.col("height") / step) * step)
        & (F.col("col") < F.floor(F.col("width") / step) * step)
    )
    keys = [
        *_group(pixels),
        F.floor(F.col("row") / step).alias("row"),
        F.floor(F.col("col") / step).alias("col"),
        F.floor(F.col("height") / step).alias("height"),
        F.floor(F.col("width") / step).alias("width"),
    ]
    dtype = pixels.schema["value"].dataType
    if how == "max":
        value = F.max("value")
    elif whole:
        value = F.rint(F.avg("value")).cast(dtype)
    else:
        value = F.avg("value").cast(dtype)
    return live.groupBy(*keys).agg(value.alias("value"))


def _stored_levels(base: DataFrame | None, first: DataFrame, coarser: Callable[[DataFrame], DataFrame], start: int, count: int) -> DataFrame:
    """Union of up to ``count`` levels, each made from the stored one before it.

    A level is written once to the checkpoint folder and read by the next level and by the output,
    so the finest level is read once and the work shrinks geometrically. (Left in one plan, filters
    pushed down from coarse levels would make every level rebuild all finer ones.) Stops when no raster
    has a further level.
    """
    out = None if base is None else base.withColumn("level", F.lit(start - 1).cast("bigint"))
    current = first
    for level in range(start, start + count):
        current = materialize(coarser(current))
        if out is not None and current.isEmpty():
            break
        one = current.withColumn("level", F.lit(level).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def _pyramid(
    pixels: DataFrame, step: int, how: str, min_size: int, max_levels: int, whole: bool, first_level: int
) -> DataFrame:
    return _stored_levels(None, pixels, lambda df: _reduce(df, step, how, min_size, whole), first_level, max_levels)


def subsample_pyramid(
    pixels: DataFrame, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Every second row and column per level, base included as level 0.

    A pixel survives to level k when both indices are multiples of 2**k, so each pixel lists its own
    levels in one narrow pass: no shuffle and no chain.
    """
    def halved(size: Column, k: int) -> Column:
        return F.ceil(size / (1 << k))

    keep = []
    for k in range(max_levels):
        side = 1 << k
        alive = F.lit(True) if k == 0 else F.greatest(halved(F.col("height"), k - 1), halved(F.col("width"), k - 1)) > min_size
        fits = (F.col("row") % side == 0) & (F.col("col") % side == 0)
        keep.append(F.when(alive & fits, F.lit(k)))
    found = pixels.withColumn("level", F.explode(F.array_compact(F.array(*keep))))
    scale = F.pow(F.lit(2), F.col("level")).cast("bigint")
    return found.select(
        *_group(pixels),
        F.col("level").cast("bigint").alias("level"),
        F.floor(F.col("row") / scale).alias("row"),
        F.floor(F.col("col") / scale).alias("col"),
        F.ceil(F.col("height") / scale).alias("height"),
        F.ceil(F.col("width") / scale).alias("width"),
        "value",
    )


def mean_pyramid(
    pixels: DataFrame, step: int = 4, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Block means, base excluded; whole-number rasters are rounded half-even at each level."""
    whole = dict(pixels.dtypes)["value"] not in ("double", "float")
    return _pyramid(pixels, max(2, step), "mean", min_size, max_levels, whole, 1)


def _tile_side(step: int) -> int:
    return TILE - TILE % step


def _through_tiles(pixels: DataFrame, levels: Callable[[DataFrame], DataFrame], tile: int, keep_zero: bool = True) -> DataFrame:
    """Pixel rows packed once, handed on as tiles, and the tiles that come back as pixel rows."""
    kind = dict(pixels.dtypes)["value"]
    packed = tiles.pack_tiles(pixels, _STORED_AS[kind], tile)
    out = tiles.unpack_tiles(levels(packed), kind, tile, keep_zero)
    return out.drop(*(c for c in ("section", "key", "channel") if c not in pixels.columns))


def max_pyramid(
    pixels: DataFrame,
    step: int = 4,
    min_size: int = MIN_SIZE,
    max_levels: int = MAX_LEVELS,
    with_base: bool = False,
) -> DataFrame:
    """Block maxima, so that label ids survive; optionally with the base as level 0. Absent pixels are 0.

    The pixel view of :func:`cytoplane.operators.tiles.tile_pyramid`.
    """
    step = max(2, step)
    side, last = _tile_side(step), max_levels - 1 if with_base else max_levels
    coarse = _through_tiles(pixels, lambda t: tiles.tile_pyramid(t, step, "max", min_size, last, side), side)
    return pixels.withColumn("level", F.lit(0).cast("bigint")).unionByName(coarse) if with_base else coarse


def outline_mask(labels: DataFrame, width: int = 1, pad: bool = True) -> DataFrame:
    """Foreground pixels with a different 4-neighbour, grown to ``width``; one row per set pixel.

    Each foreground pixel tells its four neighbours its label; a pixel then compares what it heard
    with its own. One aggregation replaces four self-joins, and its partial step already merges
    neighbours that share a partition. With ``pad`` the raster is surrounded by background, so cells
    at the border get an outline there. A wider outline is drawn on tiles, by distances.
    """
    keys = _group(labels)
    inside = (F.col("row").between(0, F.col("height") - 1)) & (F.col("col").between(0, F.col("width") - 1))
    if width > 1:
        kept = [c for c in labels.columns if c not in ("value", "level")]
        return _through_tiles(labels, lambda t: tiles.outline_tiles(t, width, TILE, pad), TILE, keep_zero=False).select(*kept)
    fg = labels.filter(F.col("value") != 0)
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    told = fg.withColumn("_d", F.explode(F.array(*[
        F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c"), F.lit(dr == 0 and dc == 0).alias("own")) for dr, dc in steps
    ]))).select(
        *keys,
        (F.col("row") + F.col("_d.r")).alias("row"),
        (F.col("col") + F.col("_d.c")).alias("col"),
        "height",
        "width",
        F.when(F.col("_d.own"), F.col("value")).alias("_own"),
        F.when(~F.col("_d.own"), F.col("value")).alias("_seen"),
    ).filter(inside)
    judged = told.groupBy(*keys, "row", "col", "height", "width").agg(
        F.max("_own").alias("_own"),
        F.min("_seen").alias("_low"),
        F.max("_seen").alias("_high"),
        F.count("_seen").alias("_heard"),
    )
    border = sum(
        (
            F.when(edge, F.lit(1)).otherwise(F.lit(0))
            for edge in (
                F.col("row") == 0,
                F.col("col") == 0,
                F.col("row") == F.col("height") - 1,
                F.col("col") == F.col("width") - 1,
            )
        ),
        F.lit(0),
    )
    expected = F.lit(4) if pad else F.lit(4) - border
    # A neighbour that stays silent is background (or, with padding, beyond the border).
    differs = (F.col("_heard") < expected) | (F.col("_low") != F.col("_own")) | (F.col("_high") != F.col("_own"))
    outline = judged.filter(F.col("_own").isNotNull() & F.coalesce(differs, F.col("_heard") < expected)).select(
        *keys, "row", "col", "height", "width"
    )
    return outline


def outline_coverage_pyramid(
    labels: DataFrame, width: int = 1, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Outline coverage 0..255, base included, then block means with step 2. Only pixels above zero are rows."""
    def levels(packed: DataFrame) -> DataFrame:
        return tile_coverage(packed, width, min_size, max_levels)

    return _through_tiles(labels, levels, TILE, keep_zero=False)


def tile_coverage(
    labels: DataFrame, width: int = 1, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS, tile: int = TILE
) -> DataFrame:
    """The same from label tiles to tiles; tiles without any outline are not kept."""
    drawn = tiles.outline_tiles(labels, width, tile, value=COVERAGE)
    base = materialize(drawn.filter(F.col("data") != F.expr("unhex(repeat('00', octet_length(data)))")))
    return base.unionByName(tiles.tile_pyramid(base, 2, "mean", min_size, max_levels - 1, tile, sparse=True))


def density_grid(points: DataFrame, bin_size: float, channel: Column | None = None) -> DataFrame:
    """Counts of points per square bin, one channel per section unless a channel is given."""
    placed = points.select(
        "section",
        (F.lit("all") if channel is None else channel).alias("channel"),
        F.floor(F.col("y") / bin_size).alias("row"),
        F.floor(F.col("x") / bin_size).alias("col"),
    )
    return placed.groupBy("section", "channel", "row", "col").agg(F.count(F.lit(1)).cast("float").alias("value"))


def density_pyramid(
    grid: DataFrame, height: int, width: int, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """float32 2x2 means of a density grid, base included; empty bins are not stored.

    Unlike the image pyramid a raster one bin high (or wide) is still halved along its other side.
    """
    def block(size: str) -> Column:
        return F.when(F.col(size) >= 2, F.lit(2)).otherwise(F.lit(1))

    base = materialize(grid.withColumn("height", F.lit(height).cast("bigint")).withColumn("width", F.lit(width).cast("bigint")))
    group = _group(base)

    def halve(df: DataFrame) -> DataFrame:
        live = df.filter(
            (F.greatest("height", "width") > min_size)
            & (F.col("row") < F.floor(F.col("height") / block("height")) * block("height"))
            & (F.col("col") < F.floor(F.col("width") / block("width")) * block("width"))
        )
        keys = [
            *group,
            F.floor(F.col("row") / block("height")).alias("row"),
            F.floor(F.col("col") / block("width")).alias("col"),
            F.floor(F.col("height") / block("height")).alias("height"),
            F.floor(F.col("width") / block("width")).alias("width"),
            (block("height") * block("width")).alias("_area"),
        ]
        sums = live.groupBy(*keys).agg(F.sum(F.col("value").cast("double")).alias("value"))
        return sums.withColumn("value", (F.col("value") / F.col("_area")).cast("float")).drop("_area")

    return _stored_levels(base, base, halve, 1, max_levels - 1)


def complete_pyramid(
    stored: DataFrame, last_level: int | None = None, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Append coarse levels to shallow stored pyramids, each from its own last level.

    ``last_level`` starts all of them from that level instead.
    """
    raster = [c for c in ("section", "key", "channel") if c in stored.columns]
    if last_level is None:
        ends = stored.groupBy(*raster).agg(F.max("level").alias("_last"))
        last = stored.join(ends, raster).filter(F.col("level") == F.col("_last")).drop("_last")
    else:
        last = stored.filter(F.col("level") == last_level)
    return stored.unionByName(_through_tiles(last, lambda t: tiles.tile_pyramid(t, 2, "mean", min_size, max_levels - 1), TILE))


def complete_tiles(stored: DataFrame, min_size: int = MIN_SIZE, max_levels: int = MAX_LEVELS, tile: int = TILE) -> DataFrame:
    """The same for stored tiles."""
    raster = ["section", "key", "channel"]
    ends = stored.groupBy(*raster).agg(F.max("level").alias("_last"))
    last = stored.join(ends, raster).filter(F.col("level") == F.col("_last")).drop("_last")
    return stored.unionByName(tiles.tile_pyramid(last, 2, "mean", min_size, max_levels - 1, tile))


def value_overlay(labels: DataFrame, bins: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Bin of each pixel of label tiles; background and cells without a bin have none."""
    on = on or []
    return tiles.overlay_tiles(labels, bins.select(*on, F.col("label_id").alias("label"), "bin"), "bin", on)


def cell_type_overlay(labels: DataFrame, types: DataFrame, level: str = "broad", on: list[str] | None = None) -> DataFrame:
    """Cell type of each pixel of label tiles; background and cells that are off have none."""
    on = on or []
    return tiles.overlay_tiles(labels, types.select(*on, F.col("cell_id").alias("label"), F.col(level).alias("cell_type")), "cell_type", on)


# ---------------------------------------------------------------------------------------------
# Polygons to pixels
# ---------------------------------------------------------------------------------------------

#: Tile rows that are settled together, and pieces of one band in a batch above which they are settled at once.
BAND = 64
CROWD = 64
#: Cells of one image tile that one task measures.
CELLS = 20_000


def _ring_mask(cols: np.ndarray, rows: np.ndarray, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Pixels of a window inside a ring or on its boundary."""
    y = np.arange(r0, r1, dtype=float)[:, None]
    x = np.arange(c0, c1, dtype=float)[None, :]
    odd = np.zeros((r1 - r0, c1 - c0), dtype=bool)
    edge = np.zeros_like(odd)
    for ax, ay, bx, by in zip(cols, rows, np.roll(cols, -1), np.roll(rows, -1)):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        odd ^= ((ay > y) != (by > y)) & ((side > 0) if by > ay else (side < 0))
        edge |= (
            (np.abs(side) <= 1e-12 * max(1.0, abs(bx - ax) + abs(by - ay)))
            & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        )
    return odd | edge


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of set pixels."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    return rows, starts, np.nonzero(change == -1)[1] - 1


def _canvas(rec) -> tuple[np.ndarray, int, int] | None:
    """One cell inside one tile: 1 inside, 2 in a hole, with the window's first row and column.

    Rings are drawn in order, so a later part covers an earlier hole. The window never exceeds the tile.
    """
    rings = [
        (np.asarray(ring["cols"], dtype=float), np.asarray(ring["rows"], dtype=float), bool(ring["hole"]))
        for ring in rec.rings
    ]
    rings = [r for r in rings if len(r[0]) >= 3 and np.isfinite(r[0]).all() and np.isfinite(r[1]).all()]
    if not rings:
        return None
    r0 = max(min(int(np.floor(r.min())) for _, r, _ in rings), rec.row0)
    r1 = min(max(int(np.ceil(r.max())) for _, r, _ in rings) + 1, rec.row1)
    c0 = max(min(int(np.floor(c.min())) for c, _, _ in rings), rec.col0)
    c1 = min(max(int(np.ceil(c.max())) for c, _, _ in rings) + 1, rec.col1)
    if r1 <= r0 or c1 <= c0:
        return None
    canvas = np.zeros((r1 - r0, c1 - c0), dtype=np.int8)
    for cols, rows, hole in rings:
        canvas[_ring_mask(cols, rows, r0, r1, c0, c1)] = 2 if hole else 1
    return canvas, r0, c0


def _runs_of(canvas: np.ndarray, state: int, r0: int, c0: int) -> np.ndarray:
    """Runs of a state as (row, first column, last column)."""
    row, first, last = _runs(canvas == state)
    return np.stack([row + r0, first + c0, last + c0], axis=1).astype(np.int32)


def _placed(cells: DataFrame, height, width, transform: dict[str, Column], tile: int) -> DataFrame:
    """Cells in pixel coordinates, cut by tile before any Python sees them: one row per cell and tile."""
    near = tile_windows(cells, height, width, transform, tile)
    rings = F.expr(
        f"flatten(transform(parts, p -> transform({g.rings_of_part('p')}, (ring, i) -> named_struct("
        "'cols', transform(ring, v -> _inv.a * v.x + _inv.b * v.y + _inv.c), "
        "'rows', transform(ring, v -> _inv.d * v.x + _inv.e * v.y + _inv.f), 'hole', i > 0))))"
    )
    return near.select(
        "section",
        *_seg(cells),
        F.col("cell_id").cast("string").alias("cell_id"),
        F.col("shape_ord").cast("bigint").alias("draw"),
        *(F.col(c).cast("bigint").alias("value") for c in ("label_id",) if c in cells.columns),
        rings.alias("rings"),
        "ty",
        "tx",
        (F.col("ty") * tile).alias("row0"),
        F.least((F.col("ty") + 1) * tile, F.col("_h")).alias("row1"),
        (F.col("tx") * tile).alias("col0"),
        F.least((F.col("tx") + 1) * tile, F.col("_w")).alias("col1"),
    )


def _seg(cells: DataFrame) -> list[str]:
    return [c for c in ("seg_key",) if c in cells.columns]


def last_drawn(first: list[int], last: list[int], rank: list[int]) -> list[tuple[int, int, int]]:
    """The visible stretches of runs in one pixel row: (from, to, run), where the run of highest rank is on top.

    One sweep over runs in order of their first column; a heap holds those that are open, so the work does not grow with
    the number of pixels.
    """
    order = sorted(range(len(first)), key=first.__getitem__)
    out: list[tuple[int, int, int]] = []
    open_runs: list[tuple[int, int]] = []
    at, k = 0, 0
    while k < len(order) or open_runs:
        if not open_runs:
            at = first[order[k]]
        while k < len(order) and first[order[k]] <= at:
            heapq.heappush(open_runs, (-rank[order[k]], order[k]))
            k += 1
        while open_runs and last[open_runs[0][1]] < at:
            heapq.heappop(open_runs)
        if not open_runs:
            continue
        top = open_runs[0][1]
        end = min(last[top], first[order[k]] - 1) if k < len(order) else last[top]
        if out and out[-1][2] == top and out[-1][1] == at - 1:
            out[-1] = (out[-1][0], end, top)
        else:
            out.append((at, end, top))
        at = end + 1
    return out


class _Layers:
    """Runs of several cells in one band of a tile, with the draw order, cell and value of each."""

    def __init__(self):
        self.runs: list[np.ndarray] = []
        self.draws: list[int] = []
        self.cells: list[str] = []
        self.values: list[int] = []

    def add(self, runs: np.ndarray, draws, cells, values) -> None:
        """Runs are (row, first, last, layer); layers are counted from those given here."""
        self.runs.append(runs + np.array([0, 0, 0, len(self.draws)], dtype=np.int32))
        self.draws += draws
        self.cells += cells
        self.values += values

    def settle(self) -> None:
        """Keep what is visible."""
        runs = np.concatenate(self.runs)
        order = sorted(range(len(self.draws)), key=lambda k: (self.draws[k], self.cells[k]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.diff(runs[:, 0])) + 1
        seen = []
        for part in np.split(runs, cuts):
            layers = part[:, 3]
            told = last_drawn(part[:, 1].tolist(), part[:, 2].tolist(), rank[layers].tolist())
            seen += [(part[0, 0], a, b, layers[k]) for a, b, k in told]
        made = np.array(seen, dtype=np.int32).reshape(-1, 4)
        used, made[:, 3] = np.unique(made[:, 3], return_inverse=True)
        self.runs = [made]
        self.draws, self.cells, self.values = ([x[k] for k in used] for x in (self.draws, self.cells, self.values))


def raster_runs(cells: DataFrame, height, width, transform: dict[str, Column], tile: int = TILE) -> DataFrame:
    """Label raster of cell polygons as runs (section, [seg_key], row, col0, col1, value); background is not stored.

    Boundary pixels belong to a cell, a later shape lies on top, holes cut to background. Cells become runs by tile;
    each band of a tile is then swept row by row. A task settles what it drew of a crowded band before it sends it, so
    no band gets more from a task than its own pixels. ``cells`` carries bounds, ``shape_ord`` and ``label_id``;
    segmentations of a section stay apart.
    """
    seg = _seg(cells)
    keys = ["section", *seg, "ty", "tx", "band"]
    kinds = ", ".join(f"{k} {'string' if k in ('section', 'seg_key') else 'bigint'}" for k in keys)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bands: dict[tuple, _Layers] = {}
            for rec in pdf.itertuples(index=False):
                made = _canvas(rec)
                if made is None:
                    continue
                canvas, r0, c0 = made
                for state, value in ((1, int(rec.value)), (2, 0)):
                    runs = _runs_of(canvas, state, r0, c0)
                    place = (runs[:, 0] - rec.row0) // BAND
                    for band in np.unique(place).tolist():
                        layers = bands.setdefault((*(getattr(rec, k) for k in keys[:-1]), band), _Layers())
                        mine = runs[place == band]
                        layers.add(np.column_stack([mine, np.zeros(len(mine), np.int32)]), [int(rec.draw)], [rec.cell_id], [value])
                        if len(layers.runs) > CROWD:
                            layers.settle()
            yield pd.DataFrame(
                [(*key, np.concatenate(x.runs).astype(np.int32).tobytes(), x.draws, x.cells, x.values) for key, x in bands.items()],
                columns=[*keys, "runs", "draws", "cells", "values"])

    def settle(group: pa.Table) -> pa.Table:
        layers = _Layers()
        for row in group.select(["runs", "draws", "cells", "values"]).to_pylist():
            layers.add(np.frombuffer(row["runs"], np.int32).reshape(-1, 4), row["draws"], row["cells"], row["values"])
            if len(layers.runs) > CROWD:
                layers.settle()
        layers.settle()
        runs = layers.runs[0]
        values = np.array(layers.values, dtype=np.int64)[runs[:, 3]]
        runs, values = runs[values != 0].astype(np.int64), values[values != 0]
        lead = [pa.array([group.column(k)[0].as_py()] * len(runs), pa.string()) for k in keys[:-3]]
        return pa.table([*lead, *(pa.array(runs[:, k]) for k in range(3)), pa.array(values)], [*keys[:-3], "row", "col0", "col1", "value"])

    drawn = _placed(cells, height, width, transform, tile).mapInPandas(
        draw, f"{kinds}, runs binary, draws array<bigint>, cells array<string>, values array<bigint>")
    return drawn.groupBy(*keys).applyInArrow(
        settle, ", ".join(f"{k} string" for k in keys[:-3]) + ", row bigint, col0 bigint, col1 bigint, value bigint")


def rasterize_cells(
    cells: DataFrame, height, width, transform: dict[str, Column], tile: int = TILE
) -> DataFrame:
    """The pixel view of :func:`raster_runs`: one row per pixel that belongs to a cell."""
    runs = raster_runs(cells, height, width, transform, tile)
    return runs.select(*[c for c in runs.columns if c not in ("col0", "col1", "value")], F.explode(F.sequence("col0", "col1")).alias("col"), "value")


def runs_to_tiles(runs: DataFrame, height: int, width: int, key: str, tile: int = TILE) -> DataFrame:
    """Label tiles from runs; ``seg_key`` becomes the raster's key where there is one."""
    lead = F.col("seg_key") if "seg_key" in runs.columns else F.lit(key)
    placed = runs.select(
        "section", lead.alias("key"), F.lit("c0").alias("channel"), F.lit(0).cast("bigint").alias("level"),
        F.floor(F.col("row") / tile).alias("ty"), F.floor(F.col("col0") / tile).alias("tx"), "row", "col0", "col1", "value")

    def paint(group: pa.Table) -> pa.Table:
        place = {k: group.column(k)[0].as_py() for k in tiles.TILE_KEYS} | {"height": height, "width": width}
        r0, c0 = place["ty"] * tile, place["tx"] * tile
        data = np.zeros((min(tile, height - r0), min(tile, width - c0)), dtype=np.int64)
        for row, first, last, value in zip(*(group.column(c).to_pylist() for c in ("row", "col0", "col1", "value"))):
            data[row - r0, first - c0:last - c0 + 1] = value
        return tiles.one_tile(place, data)

    return placed.groupBy(*tiles.TILE_KEYS).applyInArrow(paint, tiles.SCHEMA)


def run_sums(data: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the pixels of each run (row, first, last) that are not NaN, by two look-ups in prefix sums."""
    row, first, last = runs[:, 0], runs[:, 1], runs[:, 2] + 1

    def prefix(values: np.ndarray) -> np.ndarray:
        out = np.zeros((values.shape[0], values.shape[1] + 1), dtype=values.dtype)
        np.cumsum(values, axis=1, out=out[:, 1:])
        return out[row, last] - out[row, first]

    if data.dtype.kind != "f":
        return prefix(data.astype(np.int64)).astype(np.float64), last - first
    data = data.astype(np.float64)
    usable = ~np.isnan(data)
    total = prefix(np.where(np.isfinite(data), data, 0.0))
    if np.isinf(data).any():
        for sign in (1, -1):
            total[prefix((data == sign * np.inf).astype(np.int64)) > 0] += sign * np.inf
    return total, prefix(usable.astype(np.int64))


def cell_channel_intensity(
    cells: DataFrame, pixels: DataFrame, height, width, transform: dict[str, Column], tile: int = TILE, channels: DataFrame | None = None
) -> DataFrame:
    """Mean of the non-NaN pixels in each cell per image and channel; cells without pixels are null.

    ``pixels`` are image tiles of side ``tile`` (pixel rows are packed first, absent ones count as NaN). Cells do not take
    pixels from each other. Runs of cells meet the tile they lie in, whose prefix sums along rows answer a run with two
    look-ups; what leaves a task is one row per cell, tile and channel. Tiles with very many cells are split by cell.
    ``channels`` (section, key, channel) spares a look at all tiles for the channels there are.
    """
    seg = _seg(cells)
    if "data" not in pixels.columns:
        h, w = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
        sized = pixels.filter(F.col("value").isNotNull()).withColumns({"height": h.cast("bigint"), "width": w.cast("bigint"), "value": F.col("value").cast("double")})
        keyed = sized if "key" in pixels.columns else sized.withColumn("key", F.lit(""))
        image, had_key = tiles.pack_tiles(keyed, "float64", tile, float("nan")), "key" in pixels.columns
    else:
        image, had_key = pixels, "key" in pixels.columns
    # As runs, so that what is sent to a tile is a few numbers a cell and row.
    names = ["section", *seg, "cell_id", "ty", "tx", "runs"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.itertuples(index=False):
                made = _canvas(rec)
                if made is None:
                    continue
                canvas, r0, c0 = made
                runs = _runs_of(canvas, 1, r0 - rec.row0, c0 - rec.col0)
                if len(runs):
                    out.append((*(getattr(rec, k) for k in names[:-1]), runs.tobytes()))
            yield pd.DataFrame(out, columns=names)

    lead = "".join(f"{k} string, " for k in ("section", *seg, "cell_id"))
    # Stored, as cells are counted by tile before they are drawn.
    placed = materialize(_placed(cells, height, width, transform, tile))
    runs = placed.mapInPandas(draw, lead + "ty bigint, tx bigint, runs binary")
    keys = ["section", "ty", "tx"]
    dealt, copied = split_hot(runs, image.select("section", "key", "channel", "ty", "tx", "h", "w", "dtype", "data"), keys, F.xxhash64("cell_id"), CELLS, placed.select(*keys))

    def measure(mine: pa.Table, planes: pa.Table) -> pa.Table:
        blobs = mine.column("runs").to_pylist()
        every = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum([len(b) // 12 for b in blobs])[:-1]]).astype(np.int64)
        out = []
        for plane in planes.to_pylist() if blobs else []:
            total, count = run_sums(tiles.pixels_of(plane), every)
            sums, counts = np.add.reduceat(total, starts), np.add.reduceat(count, starts)
            head = [pa.array([plane[k]] * len(blobs), pa.string()) for k in ("key", "channel")]
            out.append(pa.table([*(mine.column(c) for c in ("section", *seg, "cell_id")), *head, pa.array(sums), pa.array(counts)], measured))
        return pa.concat_tables(out) if out else none

    measured = ["section", *seg, "cell_id", "key", "channel", "_sum", "_n"]
    kinds = [pa.string()] * (len(measured) - 2) + [pa.float64(), pa.int64()]
    none = pa.table({n: pa.array([], t) for n, t in zip(measured, kinds)})
    group = [*keys, "_salt"]
    met = dealt.groupBy(*group).cogroup(copied.groupBy(*group)).applyInArrow(
        measure, lead + "key string, channel string, _sum double, _n bigint")
    of_image = ["section", "key", "channel"]
    each = ["section", *seg, "cell_id"]
    sums = met.filter("_n > 0").groupBy(*each, *of_image[1:]).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    known = (image if channels is None else channels).select(*of_image).distinct()
    every = cells.select("section", *seg, F.col("cell_id").cast("string").alias("cell_id")).join(known, "section")
    out = every.join(sums, [*each, *of_image[1:]], "left").select(
        *each, *of_image[1:], (F.col("_sum") / F.col("_n")).alias("mean"), F.coalesce("_n", F.lit(0)).alias("n"))
    return out if had_key else out.drop("key")
