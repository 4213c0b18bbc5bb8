"""Rasters as tiles: one row per tile with its pixels as a binary array.

``tiles(section, key, channel, level, ty, tx, h, w, height, width, dtype, data)``. This is the
storage form; the pixel rows of :mod:`cytoplane.operators.raster` are the relational form of the same
table. Kernels see one tile at a time (with a border where they need neighbours), so memory is
bounded by the tile size and never by how many tiles a raster has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.operators.cells import TILE
from cytoplane.session import materialize

# Limits of a display pyramid.
MIN_SIZE = 1024
MAX_LEVELS = 10

#: What tells a tile from all others.
TILE_KEYS = ("section", "key", "channel", "level", "ty", "tx")
SCHEMA = (
    "section string, key string, channel string, level bigint, ty bigint, tx bigint, "
    "h bigint, w bigint, height bigint, width bigint, dtype string, data binary"
)
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_TYPES = {name: _ARROW[kind] for name, kind in (part.split() for part in SCHEMA.split(", "))}


def pack_tiles(pixels: DataFrame, dtype: str, tile: int = TILE, fill: float = 0) -> DataFrame:
    """Pixel rows to tiles; absent pixels are ``fill``. A group is at most one tile of pixels."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        r0, c0 = int(first.ty) * tile, int(first.tx) * tile
        h, w = min(tile, int(first.height) - r0), min(tile, int(first.width) - c0)
        data = np.full((h, w), fill, dtype=dtype)
        data[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["value"].to_numpy()
        return pd.DataFrame([[
            first.section, first.key, first.channel, first.level, first.ty, first.tx,
            h, w, first.height, first.width, dtype, data.tobytes(),
        ]], columns=_NAMES)

    level = F.col("level") if "level" in pixels.columns else F.lit(0)
    placed = pixels.select(
        *(F.col(c) if c in pixels.columns else F.lit("").alias(c) for c in ("section", "key", "channel")),
        level.cast("bigint").alias("level"), "row", "col", "value", "height", "width",
        F.floor(F.col("row") / tile).alias("ty"), F.floor(F.col("col") / tile).alias("tx"),
    )
    return placed.groupBy(*TILE_KEYS).applyInPandas(pack, SCHEMA)


def tiles_from_rows(rows: DataFrame, dtype: str, tile: int = TILE) -> DataFrame:
    """Raster rows (section, key, channel, row, values, height, width) to tiles: rows are cut, never taken apart.

    A group is at most ``tile`` strips of at most ``tile`` values. Absent rows are zero; ``level`` is kept where there is one.
    """
    strip = F.slice(F.col("values"), F.col("tx").cast("int") * tile + 1, F.lit(tile))
    level = F.col("level").cast("bigint") if "level" in rows.columns else F.lit(0).cast("bigint")
    cut = rows.select(
        "section", "key", "channel", level.alias("level"), F.floor(F.col("row") / tile).alias("ty"), "row", "values", "height", "width",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("width") / tile) - 1)).alias("tx"),
    ).select(*TILE_KEYS, "row", "height", "width", strip.alias("strip"))

    def pack(group: pa.Table) -> pa.Table:
        first = {k: group.column(k)[0].as_py() for k in group.column_names if k not in ("row", "strip")}
        h, w = min(tile, first["height"] - first["ty"] * tile), min(tile, first["width"] - first["tx"] * tile)
        data = np.zeros((h, w), dtype=dtype)
        values = group.column("strip").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        data[group.column("row").to_numpy() - first["ty"] * tile] = values.reshape(-1, w)
        return one_tile(first, data)

    return cut.groupBy(*TILE_KEYS).applyInArrow(pack, SCHEMA)


def one_tile(place: dict, data: np.ndarray) -> pa.Table:
    """A table of one tile; ``place`` has its keys and the raster's size."""
    row = place | {"h": data.shape[0], "w": data.shape[1], "dtype": data.dtype.name, "data": np.ascontiguousarray(data).tobytes()}
    return pa.table({n: pa.array([row[n]], t) for n, t in _TYPES.items()})


def pixels_of(tile: dict) -> np.ndarray:
    """The pixels of a tile that was read as a row."""
    return np.frombuffer(tile["data"], dtype=tile["dtype"]).reshape(tile["h"], tile["w"])


def unpack_tiles(tiles: DataFrame, value: str = "double", tile: int = TILE, keep_zero: bool = True) -> DataFrame:
    """Tiles to pixel rows."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                data = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
                row, col = np.nonzero(np.ones_like(data, dtype=bool) if keep_zero else data != 0)
                yield pd.DataFrame({
                    "section": t.section, "key": t.key, "channel": t.channel, "level": t.level,
                    "row": row + int(t.ty) * tile, "col": col + int(t.tx) * tile, "value": data[row, col],
                    "height": t.height, "width": t.width,
                })

    return tiles.mapInPandas(
        unpack,
        "section string, key string, channel string, level bigint, row bigint, col bigint, "
        f"value {value}, height bigint, width bigint",
    )


def retile(tiles: DataFrame, old: int, new: int = TILE) -> DataFrame:
    """Cut or merge tiles to a new size.

    Each old tile is cut where new borders pass through it, then the pieces of a new tile (at most
    its own area in pixels) are put together.
    """
    piece = SCHEMA + ", r0 bigint, c0 bigint"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                data = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
                top, left = int(t.ty) * old, int(t.tx) * old
                rows = range(top // new, (top + data.shape[0] - 1) // new + 1)
                cols = range(left // new, (left + data.shape[1] - 1) // new + 1)
                for ty in rows:
                    for tx in cols:
                        r0, c0 = max(top, ty * new), max(left, tx * new)
                        part = data[r0 - top:(ty + 1) * new - top, c0 - left:(tx + 1) * new - left]
                        yield pd.DataFrame([[
                            t.section, t.key, t.channel, t.level, ty, tx, part.shape[0], part.shape[1],
                            t.height, t.width, t.dtype, np.ascontiguousarray(part).tobytes(), r0, c0,
                        ]], columns=[*_NAMES, "r0", "c0"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        top, left = int(first.ty) * new, int(first.tx) * new
        h, w = min(new, int(first.height) - top), min(new, int(first.width) - left)
        data = np.zeros((h, w), dtype=first["dtype"])
        for t in pdf.itertuples(index=False):
            part = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
            data[int(t.r0) - top:int(t.r0) - top + int(t.h), int(t.c0) - left:int(t.c0) - left + int(t.w)] = part
        return pd.DataFrame([[*first[_NAMES[:6]], h, w, first.height, first.width, first["dtype"], data.tobytes()]], columns=_NAMES)

    pieces = tiles.select(*_NAMES).mapInPandas(cut, piece)
    return pieces.groupBy("section", "key", "channel", "level", "ty", "tx").applyInPandas(join, SCHEMA)


def shrink(data: np.ndarray, step: int, how: str) -> np.ndarray:
    """Maximum or mean of each block; trailing rows and columns that fill none are left out, whole numbers stay whole."""
    h, w = data.shape[0] // step, data.shape[1] // step
    blocks = data[:h * step, :w * step].reshape(h, step, w, step)
    if how == "max":
        return blocks.max(axis=(1, 3)) if h and w else blocks[:, 0, :, 0]
    small = blocks.mean(axis=(1, 3), dtype=np.float64)
    return (np.rint(small) if np.issubdtype(data.dtype, np.integer) else small).astype(data.dtype)


def morton(y: Column, x: Column) -> Column:
    """The bits of two numbers below 2**31 in turn, those of ``y`` first, so that siblings of a quadtree are neighbours."""
    def apart(v: Column) -> Column:
        v = v.cast("bigint")
        # Masks that keep every group of 16, 8, 4, 2 and 1 bits.
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(apart(y), 1).bitwiseOR(apart(x))


def levels_needed(side: int, step: int, min_size: int, max_levels: int) -> int:
    """How many coarser levels the largest raster side can give."""
    n = 0
    while n < max_levels and side > min_size and side >= step:
        side //= step
        n += 1
    return n


def tile_pyramid(
    tiles: DataFrame, step: int, how: str, min_size: int = MIN_SIZE, last_level: int = MAX_LEVELS, tile: int = TILE, sparse: bool = False
) -> DataFrame:
    """All coarser levels of each raster, from the level its tiles have up to ``last_level``.

    A tree of tiles. Blocks never straddle tiles, so each tile is shrunk again and again where it lies, as long as its
    side can be divided, and each time gives a piece of its ancestor. Pieces with the same ancestor, known by level and
    Morton code, are put together as one tile of full side: one shuffle for all these levels, of a third of the pixels.
    Levels beyond go on from the last one, stored. Missing tiles are background; with ``sparse`` a piece of background only
    is not sent. Rasters that are small enough, or narrower than a step, have no further level.
    """
    if tile % step:
        raise ValueError("the tile side must be a multiple of the step")
    reach = 0
    while tile % step ** (reach + 1) == 0:
        reach += 1
    schema = f"{SCHEMA}, r int, c int, z bigint"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([*_TYPES.items(), ("r", pa.int32()), ("c", pa.int32()), ("z", pa.int64())])
        for batch in batches:
            for t in batch.to_pylist():
                data, rows = pixels_of(t), []
                for up in range(1, reach + 1):
                    if max(t["height"], t["width"]) <= min_size or min(t["height"], t["width"]) < step or t["level"] >= last_level:
                        break
                    data = shrink(data, step, how)
                    # The tile's place among its ancestor's parts.
                    parts, side = step**up, tile // step**up
                    t = t | {"level": t["level"] + 1, "height": t["height"] // step, "width": t["width"] // step}
                    if data.size and (not sparse or data.any()):
                        place = {"ty": t["ty"] // parts, "tx": t["tx"] // parts, "r": t["ty"] % parts * side, "c": t["tx"] % parts * side}
                        rows.append(t | place | {"h": data.shape[0], "w": data.shape[1], "data": data.tobytes(), "z": 0})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = rows[0]
        data = np.zeros(
            (min(tile, first["height"] - first["ty"] * tile), min(tile, first["width"] - first["tx"] * tile)), dtype=first["dtype"])
        for t in rows:
            data[t["r"]:t["r"] + t["h"], t["c"]:t["c"] + t["w"]] = pixels_of(t)
        return one_tile(first, data)

    def coarser(df: DataFrame) -> DataFrame:
        sent = df.select(*_NAMES).mapInArrow(pieces, schema).withColumn("z", morton(F.col("ty"), F.col("tx")))
        return sent.groupBy("section", "key", "channel", "level", "z").applyInArrow(join, SCHEMA)

    out = coarser(tiles)
    if reach >= last_level:
        return out
    size = tiles.agg(F.max(F.greatest("height", "width")), F.min("level")).first()
    more = levels_needed(size[0] or 0, step, min_size, last_level - (size[1] or 0)) - reach
    # Each raster goes on from the last level that it has so far.
    current = out = materialize(out) if more > 0 else out
    while more > 0:
        ends = current.groupBy("section", "key", "channel").agg(F.max("level").alias("_last"))
        current = materialize(coarser(current.join(ends, ["section", "key", "channel"]).filter(F.col("level") == F.col("_last"))))
        out = out.unionByName(current)
        more -= reach
    return out


def reduce_tiles(tiles: DataFrame, step: int, how: str, tile: int = TILE) -> DataFrame:
    """One coarser level inside each tile: no shuffle, because ``tile`` is a multiple of ``step``.

    The tiles get smaller by ``step``; :func:`retile` merges them again when they are too small.
    """
    if tile % step:
        raise ValueError("the tile side must be a multiple of the step")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                data = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
                small = shrink(data, step, how)
                if not small.size:
                    continue
                rows.append([
                    t.section, t.key, t.channel, int(t.level) + 1, t.ty, t.tx, *small.shape,
                    int(t.height) // step, int(t.width) // step, t.dtype, small.tobytes(),
                ])
            yield pd.DataFrame(rows, columns=_NAMES)

    return tiles.select(*_NAMES).mapInPandas(run, SCHEMA)


def within(mask: np.ndarray, reach: int) -> np.ndarray:
    """Pixels at most ``reach`` steps up, down, left or right from a set one.

    Manhattan distances in two passes an axis, there and back; the cost of a pixel does not depend on ``reach``.
    """
    far = np.int64(mask.shape[0] + mask.shape[1] + reach + 1)
    away = np.where(mask, np.int64(0), far)
    for axis in (0, 1):
        at = np.expand_dims(np.arange(mask.shape[axis]), 1 - axis)
        there = np.minimum.accumulate(away - at, axis=axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(away + at, axis), axis=axis), axis) - at
        away = np.minimum(there, back)
    return away <= reach


def outline_tiles(tiles: DataFrame, width: int = 1, tile: int = TILE, pad: bool = True, value: int = 1) -> DataFrame:
    """Outline masks of label tiles, with a halo exchanged between neighbours.

    With ``pad`` the raster is surrounded by background, so cells at the border get an outline there. Outline pixels are ``value``.

    A tile sends each of its eight neighbours only the strip that neighbour needs, so a group is one
    tile and at most eight strips. Neighbours that are missing count as background.
    """
    halo = max(1, width)
    if halo > tile:
        raise ValueError("the outline is wider than a tile")
    strip = SCHEMA + ", dr bigint, dc bigint"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                data = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
                rows = []
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        # Seen from the receiver, this tile lies at (dr, dc).
                        ty, tx = int(t.ty) - dr, int(t.tx) - dc
                        if ty < 0 or tx < 0 or ty * tile >= int(t.height) or tx * tile >= int(t.width):
                            continue
                        r = {-1: slice(-halo, None), 0: slice(None), 1: slice(0, halo)}[dr]
                        c = {-1: slice(-halo, None), 0: slice(None), 1: slice(0, halo)}[dc]
                        part = data[r, c]
                        rows.append([
                            t.section, t.key, t.channel, t.level, ty, tx, part.shape[0], part.shape[1],
                            t.height, t.width, t.dtype, np.ascontiguousarray(part).tobytes(), dr, dc,
                        ])
                yield pd.DataFrame(rows, columns=[*_NAMES, "dr", "dc"])

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h = min(tile, int(first.height) - int(first.ty) * tile)
        w = min(tile, int(first.width) - int(first.tx) * tile)
        # One ring more than the halo stays background, so shifted views need no border cases.
        m = halo + 1
        big = np.zeros((h + 2 * m, w + 2 * m), dtype=first["dtype"])
        for t in pdf.itertuples(index=False):
            part = np.frombuffer(t.data, dtype=t.dtype).reshape(int(t.h), int(t.w))
            r = {-1: m - part.shape[0], 0: m, 1: m + h}[int(t.dr)]
            c = {-1: m - part.shape[1], 0: m, 1: m + w}[int(t.dc)]
            big[r:r + part.shape[0], c:c + part.shape[1]] = part
        mask = np.zeros(big.shape, dtype=bool)
        core = big[1:-1, 1:-1]
        there = np.ones(big.shape, dtype=bool)
        if not pad:
            row, col = (np.arange(n) + int(k) * tile - m for n, k in zip(big.shape, (first.ty, first.tx)))
            there &= ((row >= 0) & (row < int(first.height)))[:, None] & ((col >= 0) & (col < int(first.width)))[None, :]
        for near in ((slice(-2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(-2)), (slice(1, -1), slice(2, None))):
            mask[1:-1, 1:-1] |= (core != 0) & (core != big[near]) & there[near]
        if width > 1:
            mask = within(mask, width - 1)
        out = mask[m:m + h, m:m + w] * np.uint8(value)
        return pd.DataFrame([[*first[_NAMES[:6]], h, w, first.height, first.width, "uint8", out.tobytes()]], columns=_NAMES)

    sent = tiles.select(*_NAMES).mapInPandas(send, strip)
    return sent.groupBy("section", "key", "channel", "level", "ty", "tx").applyInPandas(trace, SCHEMA)


def overlay_tiles(tiles: DataFrame, found: DataFrame, name: str, on: list[str] | None = None) -> DataFrame:
    """Label tiles with a value for each label: the tile's keys and size, its labels, ``names`` and ``codes``.

    ``found`` has (*on, label, ``name``). Each tile lists its distinct labels, and only those are joined; background never
    leaves its tile. The values that come back are the tile's dictionary ``names``; ``codes`` has for every pixel its place
    there, or -1 where the label is background or has no value.
    """
    on, kind = on or [], found.schema[name].dataType.simpleString()
    keys = list(TILE_KEYS)
    listed_as = ", ".join(f"{c} {'string' if c in keys[:3] else 'bigint'}" for c in keys) + ", _label bigint"

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                labels = np.unique(pixels_of(t))
                labels = labels[labels != 0].astype(np.int64)
                yield pa.record_batch([*(pa.array([t[k]] * len(labels), _TYPES[k]) for k in keys), pa.array(labels)], [*keys, "_label"])

    listed = tiles.select(*_NAMES).mapInArrow(distinct, listed_as)
    told = found.filter(F.col(name).isNotNull()).select(*on, F.col("label").cast("bigint").alias("_label"), F.col(name).alias("_value"))
    named = listed.join(told, [*on, "_label"]).select(*keys, "_label", "_value")
    schema = f"{SCHEMA}, names array<{kind}>, codes binary"

    def apply(tile: pa.Table, values: pa.Table) -> pa.Table:
        t = tile.to_pylist()[0]
        data = pixels_of(t)
        values = values.sort_by("_label")
        labels = values.column("_label").to_numpy()
        names = values.column("_value").combine_chunks().dictionary_encode()
        places = np.append(names.indices.to_numpy(zero_copy_only=False), -1).astype(np.int32)
        at = np.searchsorted(labels, data)
        at[(at >= len(labels)) | (np.append(labels, 0)[at] != data)] = len(labels)
        words = pa.array([names.dictionary.to_pylist()], pa.list_(values.column("_value").type))
        return tile.append_column("names", words).append_column("codes", pa.array([places[at].tobytes()], pa.binary()))

    return tiles.select(*_NAMES).groupBy(*keys).cogroup(named.groupBy(*keys)).applyInArrow(apply, schema)


def unpack_overlay(tiles: DataFrame, name: str, tile: int = TILE) -> DataFrame:
    """Overlay tiles to pixel rows (section, key, channel, level, row, col, value, ``name``)."""
    kind = tiles.schema["names"].dataType.elementType.simpleString()
    schema = f"section string, key string, channel string, level bigint, row bigint, col bigint, value bigint, {name} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.schema.field("names").type.value_type
            for t in batch.to_pylist():
                row, col = np.indices((t["h"], t["w"])).reshape(2, -1)
                codes = np.frombuffer(t["codes"], np.int32)
                words = pa.array(t["names"], kept).take(pa.array(codes, mask=codes < 0))
                yield pa.record_batch([
                    *(pa.array([t[k]] * len(row), _TYPES[k]) for k in TILE_KEYS[:4]), pa.array(row + t["ty"] * tile), pa.array(col + t["tx"] * tile),
                    pa.array(pixels_of(t).reshape(-1).astype(np.int64)), words,
                ], ["section", "key", "channel", "level", "row", "col", "value", name])

    return tiles.mapInArrow(run, schema)
