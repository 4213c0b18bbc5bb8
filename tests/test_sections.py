"""Inputs with several sections, images and levels, and inputs that must not stop a job."""

import json

import pytest
from pyspark.sql import functions as F

from cytoplane.functions import affine
from cytoplane.functions import geometry as g
from cytoplane.functions.text import normalize_cell_key
from cytoplane.operators import annotations as n
from cytoplane.operators import raster as r
from cytoplane.operators import transcripts as t
from cytoplane.operators.grid import meeting_boxes
from cytoplane.sources import annotations as files
from cytoplane.sources.cells import scan_cells
from cytoplane.sources.tables import scan_pixel_transform
from cytoplane.sources.transcripts import union_sections


@pytest.fixture
def both(spark):
    m = spark.createDataFrame([("G", 1.0, 1.0, 5), ("G", 2.0, 1.0, 0)], "gene string, x double, y double, assignment long")
    x = spark.createDataFrame([("G", 1.0, 1.0, "5", None), ("G", 1.0, 2.0, "6", True)], "gene string, x double, y double, assignment string, background boolean")
    return union_sections({"M": m, "X": x})


def test_background_is_decided_by_section(both):
    assert sorted((r.section, r.background) for r in both.collect()) == [("M", False), ("M", True), ("X", False), ("X", True)]
    assert t.gene_fg_bg_counts(both).first()[1:] == (2, 2)


def test_cells_of_two_sections_stay_apart(both, spark):
    assert sorted(map(tuple, t.cell_counts(both).collect())) == [("M", "5", 1), ("X", "5", 1), ("X", "6", 1)]
    wanted = spark.createDataFrame([("X", "5")], "section string, cell_id string")
    assert [(r.section, r.cell_id) for r in t.transcripts_for_cells(both, wanted).collect()] == [("X", "5")]
    slices = {(r.section, r.cell_id): (r.start, r.end) for r in t.cell_slices(both).collect()}
    assert slices == {("M", "5"): (0, 1), ("X", "5"): (1, 2), ("X", "6"): (2, 3)}


def test_long_keys_are_kept(spark):
    df = spark.createDataFrame([("1" * 40,), ("2e38",), ("7",)], "k string")
    assert [r[0] for r in df.select(normalize_cell_key("k")).collect()] == ["1" * 40, "2e38", "7"]


def cell(*xy):
    return [{"exterior": [{"x": float(a), "y": float(b)} for a, b in xy], "holes": []}]


CELLS = f"section string, cell_id string, shape_ord long, parts {g.PARTS}"


def test_images_with_the_same_channel_stay_apart(spark):
    cells = scan_cells(spark.createDataFrame([("s", "1", 0, cell((0, 0), (4, 0), (4, 4), (0, 4)))], CELLS))
    pixels = spark.range(25).select(F.lit("s").alias("section"), (F.col("id") / 5).cast("long").alias("row"), (F.col("id") % 5).alias("col"))
    image = pixels.select("*", F.lit("A").alias("key"), F.lit("DAPI").alias("channel"), F.lit(10.0).alias("value")).union(
        pixels.select("*", F.lit("B"), F.lit("DAPI"), F.lit(30.0)))
    got = r.cell_channel_intensity(cells, image, 5, 5, affine.literal())
    assert sorted(map(tuple, got.select("key", "channel", "mean", "n").collect())) == [("A", "DAPI", 10.0, 25), ("B", "DAPI", 30.0, 25)]
    with pytest.raises(Exception, match="cannot be inverted"):
        r.rasterize_cells(cells.withColumn("label_id", F.lit(1)), 5, 5, affine.literal(a=1.0, b=2.0, d=1.0, e=2.0)).collect()


def test_geometry_that_is_not_finite_is_left_out(spark):
    rows = [("s", "1", 0, cell((0, 0), (4, 0), (4, float("inf")))), ("s", "2", 1, cell((0, 0), (4, 0), (4, 4)))]
    assert [c.cell_id for c in scan_cells(spark.createDataFrame(rows, CELLS)).collect()] == ["2"]


def test_every_pyramid_goes_on_from_its_own_last_level(spark):
    def pixels(key, level, size):
        return spark.range(size * size).select(
            F.lit("s").alias("section"), F.lit(key).alias("key"), F.lit("c0").alias("channel"), F.lit(level).alias("level"),
            (F.col("id") / size).cast("long").alias("row"), (F.col("id") % size).alias("col"), F.lit(1.0).alias("value"),
            F.lit(size).cast("long").alias("height"), F.lit(size).cast("long").alias("width"))

    stored = pixels("A", 0, 16).union(pixels("B", 0, 16)).union(pixels("B", 1, 8))
    levels = r.complete_pyramid(stored, min_size=4, max_levels=4).groupBy("key").agg(F.sort_array(F.collect_set("level")).alias("l"))
    got = {x.key: x.l for x in levels.collect()}
    assert got["A"][0] == 0 and got["A"] == got["B"] and len(got["A"]) > 2


def test_small_boxes_do_not_meet_on_a_large_box_s_level(spark):
    small = spark.range(600).select(
        F.col("id"), (F.col("id") * 10).cast("double").alias("xmin"), F.lit(0.0).alias("ymin"),
        (F.col("id") * 10 + 1).cast("double").alias("xmax"), F.lit(1.0).alias("ymax"), F.lit("s").alias("section"))
    large = spark.range(1).select((F.col("id") - 1).alias("id"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(6000.0).alias("xmax"), F.lit(6000.0).alias("ymax"), F.lit("s").alias("section"))
    every = small.union(large)
    pairs = meeting_boxes(every, every, ["section"], F.col("l_id") < F.col("r_id"))
    assert pairs.count() == 600
    # Without the condition each small box meets itself and the large one, from either side.
    assert meeting_boxes(every, every, ["section"], F.lit(True)).count() == 600 + 1 + 2 * 600


def document(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def polygon(ring, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Polygon", "coordinates": [ring]}}


def test_open_rings_and_empty_collections(spark):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4]]
    docs = spark.createDataFrame([("open", document(polygon(ring))), ("shut", document(polygon([*ring, ring[0]]))), ("none", document())], "section string, text string")
    objects, errors = files.scan_object_annotations(docs)
    assert {o.section: len(o.vertices) for o in objects.collect()} == {"open": 4, "shut": 4}
    assert [(e.section, e.rule) for e in errors.collect()] == [("none", "no_objects")]


def test_a_refusal_names_all_findings(spark):
    found = spark.range(50).select(F.format_string("finding %02d", "id").alias("message"))
    with pytest.raises(ValueError, match="50 findings, all of them in") as caught:
        files._refuse(found, "message", "no")
    path = str(caught.value).split(" in ")[1].split("\n")[0]
    assert spark.read.parquet(path).count() == 50


def shapes(spark, rows):
    kind = f"section string, role string, tissue_piece_id string, shape_ord long, vertices {g.VERTICES}"
    return spark.createDataFrame([(*a, [{"x": float(x), "y": float(y)} for x, y in v]) for *a, v in rows], kind)


def test_a_section_without_a_usable_shape_is_judged(spark):
    _, _, found = n.check_annotations(shapes(spark, [("bad", "pia", "a", 0, [(0, 0)])]))
    assert {f.rule for f in found.collect()} == {"too_few_points", "missing_edge", "no_pieces"}


def test_equal_concave_ribbons_overlap(spark):
    u = [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]
    rows = n.canonical(shapes(spark, [("s", "ribbon", p, k, u) for k, p in enumerate("ab")]))
    assert [tuple(x) for x in n.piece_overlaps(rows).collect()] == [("s", "a", "b")]


def test_exclusions_are_counted_by_piece(spark):
    square = lambda x: [(x, 1), (x + 2, 1), (x + 2, 3), (x, 3)]
    rows = [("s", "pia", p, k, [(0, 2), (9, 2)]) for k, p in enumerate("ab")]
    rows += [("s", "exclusion", "a", 0, square(1)), ("s", "exclusion", "b", 1, square(1))]
    got = n.exclusion_contacts(n.canonical(shapes(spark, rows)))
    assert {(x.piece, ": exclusion 1 " in x.message) for x in got.collect()} == {("a", True), ("b", True)}


@pytest.mark.parametrize("value,text", [(1234.0, "1.23e+03"), (0.0000123, "1.23e-05"), (123000000.0, "1.23e+08"), (27.0, "27"), (0.5, "0.5"), (999.9, "1e+03"), (0.00123, "0.00123"), (12.34, "12.3")])
def test_three_digits(spark, value, text):
    assert spark.range(1).select(n._three_digits(F.lit(value))).first()[0] == text


def test_a_missing_transform_file_falls_back(spark, tmp_path):
    assert scan_pixel_transform(spark, "MERSCOPE", str(tmp_path / "none.txt")).first().a == pytest.approx(0.108)
