"""Cells, per-cell tables and rasters: small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.functions import affine
from cytoplane.operators import cells as c
from cytoplane.operators import celltypes as ct
from cytoplane.operators import raster as r
from cytoplane.operators import tiles
from cytoplane.sources import catalog, derived, tables
from cytoplane.sources.cells import scale_number, scan_cells, scan_image

CELL = "section string, cell_id string, shape_ord int, parts array<struct<exterior:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def ring(x0, y0, x1, y1):
    x0, y0, x1, y1 = (float(v) for v in (x0, y0, x1, y1))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def cells(spark, *shapes):
    rows = [("s", str(i), k, [(ring(*box), [ring(*h) for h in holes])]) for k, (i, box, holes) in enumerate(shapes)]
    return scan_cells(spark.createDataFrame(rows, CELL))


@pytest.fixture(scope="module")
def nested(spark):
    return cells(spark, (101, (0, 0, 10, 10), []), (202, (2, 2, 6, 6), []), (303, (20, 20, 30, 30), [])).cache()


def at(spark, *points):
    return spark.createDataFrame([("s", float(x), float(y)) for x, y in points], "section string, x double, y double")


def test_smallest_cell_wins(spark, nested):
    where = at(spark, (4, 4), (8, 8), (25, 25), (100, 100), (0, 5))
    got = {(q.x, q.y): q.cell_id for q in c.locate_cell(where, nested).collect()}
    assert got == {(4.0, 4.0): "202", (8.0, 8.0): "101", (25.0, 25.0): "303", (100.0, 100.0): None, (0.0, 5.0): None}


def test_equal_areas_take_the_first_shape(spark):
    two = cells(spark, ("b", (0, 0, 4, 4), []), ("a", (1, 1, 5, 5), []))
    assert c.locate_cell(at(spark, (2, 2)), two).first().cell_id == "b"


def test_holes_and_huge_cells(spark):
    mixed = cells(spark, (1, (-1e6, -1e6, 1e6, 1e6), [(0, 0, 10, 10)]), (2, (2, 2, 3, 3), []))
    got = {(q.x, q.y): q.cell_id for q in c.locate_cell(at(spark, (2.5, 2.5), (5, 5), (50, 50), (5e5, -3e5)), mixed).collect()}
    assert got == {(2.5, 2.5): "2", (5.0, 5.0): None, (50.0, 50.0): "1", (5e5, -3e5): "1"}
    area = {q.cell_id: q.area for q in mixed.collect()}
    assert area == {"1": 4e12 - 100, "2": 1.0}


def test_stacked_cells_meet_few_points(monkeypatch):
    """Squares that all hold all points: a point that the first holds meets no more of them."""
    sides = np.arange(1.0, 2001.0)
    corners = np.stack([-sides, -sides, sides, sides], axis=1)
    x0, y0, x1, y1 = corners.T
    edges = np.stack([np.stack(e, axis=1) for e in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))], axis=1).reshape(-1, 4)
    owner = np.repeat(np.arange(2000), 4)
    x, y = np.random.default_rng(2).uniform(-0.9, 0.9, (2, 500))
    x[0] = 1.5
    met = []
    repeat = np.repeat
    monkeypatch.setattr(c, "MEETINGS", 20_000)
    monkeypatch.setattr(np, "repeat", lambda a, n: met.append(int(np.sum(n))) or repeat(a, n))
    got = c.inside_cells(x, y, edges, owner, np.arange(2000))
    monkeypatch.undo()
    assert got.tolist() == [1] + [0] * 499
    assert sum(met) < 100_000  # 2,000,000 edges and points in all, each twice


def test_equal_polygons_are_sent_once(spark):
    stack = cells(spark, *[(k, (0, 0, 4, 4), []) for k in (9, 7, 8)], (5, (0, 0, 4, 5), []))
    assert sorted((q.cell_id, q.shape_ord) for q in c._first_of_equals(stack, ["section"]).collect()) == [("5", 3), ("9", 0)]
    assert c.locate_cell(at(spark, (1, 1)), stack).first().cell_id == "9"


def test_locate_against_brute_force(spark, tiny):
    rng = np.random.default_rng(1)
    boxes = [(k, (x, y, x + w, y + h), []) for k, (x, y, w, h) in enumerate(zip(*rng.uniform(0, 90, (2, 40)), *rng.uniform(0.1, 40, (2, 40))))]
    points = rng.uniform(0, 120, (300, 2))
    got = {(q.x, q.y): q.cell_id for q in c.locate_cell(at(spark, *points), cells(spark, *boxes)).collect()}
    for x, y in points:
        inside = [((b[2] - b[0]) * (b[3] - b[1]), k) for k, b, _ in boxes if b[0] < x < b[2] and b[1] < y < b[3]]
        assert got[(x, y)] == (str(min(inside)[1]) if inside else None)


def test_geometry_with_hole(spark):
    one = c.cell_geometry(cells(spark, (1, (0, 0, 10, 10), [(0, 0, 5, 10)])).drop("area")).first()
    assert (one.area, one.cx, one.cy) == (50.0, 7.5, 5.0)


def test_tile_window(spark):
    window = affine.window_bounds(affine.literal(a=2, c=10, e=3, f=20), *[F.lit(v) for v in (0, 5, 0, 10)])
    assert tuple(spark.range(1).select(*[window[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")]).first()) == (10, 20, 30, 35)
    two = cells(spark, (1, (15, 25, 18, 28), []), (2, (100, 100, 110, 110), []))
    assert [q.cell_id for q in c.cells_in_bbox(two, 10, 20, 30, 35).collect()] == ["1"]


HALF = {"c": 0.5, "f": 0.5}


def test_raster_square(spark):
    square = cells(spark, (7, (2.5, 2.5, 6.5, 6.5), [])).withColumn("label_id", F.lit(7))
    for tile in (1024, 3):
        got = r.rasterize_cells(square, 10, 10, affine.literal(**HALF), tile).collect()
        assert len(got) == 25 and {q.value for q in got} == {7}


def test_raster_order_and_holes(spark):
    two = cells(spark, (1, (0, 0, 9, 9), []), (2, (2, 2, 7, 7), [(4, 4, 5, 5)])).withColumn("label_id", F.col("cell_id").cast("bigint"))
    got = {(q.row, q.col): q.value for q in r.rasterize_cells(two, 10, 10, affine.literal(), 4).collect()}
    assert got[(0, 0)] == 1 and got[(2, 2)] == 2 and (4, 4) not in got and len(got) == 96


def test_intensity(spark):
    rows = [("s", "c0", i, j, 10.0 if 2 <= i <= 5 and 2 <= j <= 5 else 0.0) for i in range(20) for j in range(20)]
    image = spark.createDataFrame(rows, "section string, channel string, row bigint, col bigint, value double")
    two = cells(spark, (1, (2.5, 2.5, 5.5, 5.5), []), (2, (1000, 1000, 1010, 1010), []))
    got = {q.cell_id: q["mean"] for q in r.cell_channel_intensity(two, image, 20, 20, affine.literal(**HALF)).collect()}
    assert got == {"1": 10.0, "2": None}


def block(spark, n, lo, hi):
    rows = [("s", "k", "c0", i, j, int(lo <= i < hi and lo <= j < hi), n, n) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "section string, key string, channel string, row bigint, col bigint, value bigint, height bigint, width bigint")


def test_outline_forms_agree(spark):
    labels = block(spark, 8, 2, 6)
    assert r.outline_mask(labels).count() == 12
    for width in (1, 2, 3):
        pixels = {(q.row, q.col) for q in r.outline_mask(labels, width).collect()}
        packed = tiles.pack_tiles(labels, "int64", 3)
        tiled = tiles.unpack_tiles(tiles.outline_tiles(packed, width, 3), "bigint", 3, keep_zero=False)
        assert pixels == {(q.row, q.col) for q in tiled.collect()}


def test_outline_pyramid_is_fractional(spark):
    levels = r.outline_coverage_pyramid(block(spark, 16, 2, 14), min_size=4, max_levels=4)
    assert any(0 < q.value < 255 for q in levels.filter("level = 1").collect())
    assert levels.agg(F.max("level")).first()[0] == 2


def test_mean_pyramid_keeps_mass(spark):
    pixels = block(spark, 16, 3, 11).withColumn("value", F.col("value").cast("double"))
    for row in r.mean_pyramid(pixels, 2, 2, 3).groupBy("level").agg(F.sum("value").alias("s")).collect():
        assert row.s * 4**row.level == 64.0


def test_levels_needed():
    assert r.levels_needed(4096, 2, 1024, 10) == 2 and r.levels_needed(1024, 2, 1024, 10) == 0


def test_image_planes(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], 2), (0, 1, [3.0, 4.0], 2)], "z int, row bigint, values array<double>, height bigint")
    assert scan_image(df, "k", "s").count() == 4
    with pytest.raises(Exception, match="z plane"):
        scan_image(df.withColumn("z", F.col("row")), "k", "s").collect()
    assert sorted(["scale10", "scale2", "extra", "scale0"], key=scale_number) == ["scale0", "scale2", "scale10", "extra"]


def test_quantification(spark):
    obs = spark.createDataFrame([(10 * (i + 1), [float(10 * i + j) for j in range(10)]) for i in range(4)], "label_id bigint, values array<double>")
    var = spark.createDataFrame(
        [("img", ch, stat, 5 * i + j) for i, ch in enumerate(("DAPI", "PolyT")) for j, stat in enumerate(("min", "median", "mean", "max", "iqr"))],
        "image_key string, channel string, statistic string, column_index int")
    long = tables.scan_quantification(obs, var)
    features = tables.feature_columns(var)
    got = ct.select_quantification(long, features, "dapi", "Median").orderBy("label_id").collect()
    assert [q.value for q in got] == [1.0, 11.0, 21.0, 31.0]
    assert ct.resolve_feature(features, "PolyT", "mean").first().column_index == 7
    assert ct.resolve_feature(features, "PolyT", "mode").count() == 0
    options = [(q.kind, q.name) for q in catalog.quantification_options(features).collect()]
    assert [n for k, n in options if k == "statistic"] == ["min", "median", "mean", "max", "iqr"]
    with pytest.raises(Exception, match="differ in length"):
        tables.scan_quantification(obs, var.filter("column_index < 9")).collect()


def test_clip_and_bins(spark):
    flat = spark.createDataFrame([(i, float(i)) for i in range(100)], "label_id bigint, value double")
    low_high = ct.value_clip_range(flat).first()
    assert low_high.clip_low == pytest.approx(0.99) and low_high.clip_high == pytest.approx(98.01)
    four = spark.createDataFrame([(10, 0.0), (20, 5.0), (30, float("nan")), (40, 10.0)], "label_id bigint, value double")
    bins = ct.binned_values(four, ct.value_clip_range(four, low=0.0, high=1.0), bins=4)
    assert {q.label_id: q.bin for q in bins.collect()} == {10: 0, 20: 1, 40: 3}
    same = four.withColumn("value", F.lit(3.0))
    assert ct.overlay_stats(same, ct.binned_values(same, ct.value_clip_range(same), bins=4)).first() == (4, 4, 1)
    with pytest.raises(ValueError):
        ct.require_clip_range(ct.value_clip_range(four.withColumn("value", F.lit(float("nan")))))


def test_label_ids(spark):
    ints = spark.createDataFrame([("2", 0), ("94831", 1), ("94832", 2)], "cell_id string, shape_ord int")
    assert sorted((q.cell_id, int(q.label_id), q.wide) for q in ct.label_ids(ints).collect()) == [("2", 2, False), ("94831", 94831, False), ("94832", 94832, False)]
    big = spark.createDataFrame([("3715213700018100006", 0)], "cell_id string, shape_ord int")
    assert [(str(q.label_id), q.wide) for q in ct.label_ids(big).collect()] == [("3715213700018100006", True)]
    names = spark.createDataFrame([("zz", 0), ("aa", 1), ("zz", 2)], "cell_id string, shape_ord int")
    assert {q.cell_id: int(q.label_id) for q in ct.label_ids(names).collect()} == {"zz": 1, "aa": 2}


def test_cell_types(spark):
    df = spark.createDataFrame(
        [("1", "Neurons", "n1", "excitatory"), ("2", "neurons", "nan", "Inhibitory"), ("3", "nan", "x", None), ("x", "Astro", "a", None), ("5", " Astro ", "a:1", None)],
        "cell string, broad_class string, hierarchical_cluster string, neuron_split_label string")
    got = {q.cell_id: (q.broad, q.fine) for q in tables.scan_cell_types(df).collect()}
    assert got == {1: ("Excitatory neurons", "n1"), 2: ("Inhibitory neurons", "Inhibitory neurons"), 5: ("Astro", "a:1")}


def test_transforms(spark, tmp_path):
    (tmp_path / "m.csv").write_text("2 0 10\n0 4 20\n0 0 1\n")
    (tmp_path / "s.json").write_text('{"pixel_size": 0.3}')
    m = tables.scan_pixel_transform(spark, "MERSCOPE", str(tmp_path / "m.csv")).first()
    assert (m.a, m.c, m.e, m.f) == (0.5, -5.0, 0.25, -5.0)
    assert tables.scan_pixel_transform(spark, "xenium", str(tmp_path / "s.json")).first().a == 0.3
    assert tables.scan_pixel_transform(spark, "MERSCOPE").first().e == 0.108
    with pytest.raises(ValueError):
        tables.scan_pixel_transform(spark, "other")


@pytest.mark.parametrize("keys, want", [
    (["cell_boundaries", "MOSAIK_proseg", "zz"], "MOSAIK_proseg"), (["zz", "cell_boundaries"], "cell_boundaries"), (["zz", "aa"], "aa")])
def test_preferred_element(spark, keys, want):
    df = spark.createDataFrame([("s", k) for k in keys], "section string, key string")
    assert catalog.preferred_element(df).first().key == want


def test_derived_tables(spark, tmp_path):
    path, made = str(tmp_path / "d"), []

    def build():
        made.append(1)
        return spark.range(3)

    for width in (1, 1, 2):
        assert derived.materialize_derived(spark, path, {"width": width}, build).count() == 3
    assert len(made) == 2
    foreign = str(tmp_path / "foreign")
    spark.range(2).write.parquet(foreign)
    with pytest.raises(derived.ForeignElement):
        derived.materialize_derived(spark, foreign, {}, build)
    assert spark.read.parquet(foreign).count() == 2
