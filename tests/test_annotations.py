"""Annotation rules, files and streams: small inputs with known findings."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cytoplane.operators import annotations as n
from cytoplane.sources import annotations as files
from cytoplane.streaming import counts as st

SCHEMA = "section string, role string, tissue_piece_id string, shape_ord bigint, vertices array<struct<x:double,y:double>>"


def drawn(spark, **roles):
    """Shapes as lists of (y, x), the order they are drawn in."""
    rows = []
    for role, shapes in roles.items():
        for k, shape in enumerate(shapes):
            piece, points = shape if isinstance(shape, tuple) else (None, shape)
            rows.append(("s", role, piece, k, [(float(x), float(y)) for y, x in points]))
    return spark.createDataFrame(rows, SCHEMA)


def judged(df):
    usable, merged, found = n.check_annotations(df)
    rows = found.collect()
    return usable, merged, found, {r.rule for r in rows if r.severity == "error"}, {r.rule for r in rows if r.severity == "warning"}


U = [[0, 0], [50, 0], [50, 100], [0, 100]]


def test_export_keeps_xy(spark, tmp_path):
    df = drawn(
        spark,
        side=[[[200, 100], [250, 100], [265, 200], [215, 200]]],
        pia=[("piece_a", [[200, 100], [205, 150], [215, 200]])],
        wm=[("piece_a", [[250, 100], [255, 150], [265, 200]])],
        exclusion=[("piece_a", [[225, 140], [225, 160], [235, 160], [235, 140]])],
    )
    usable, merged, found, errors, _ = judged(df)
    assert not errors
    features = n.annotation_features(usable, merged, "XENIUM")
    ordered = [json.loads(r.feature) for r in features.orderBy("ord_piece", "ord_role").collect()]
    assert [f["properties"]["role"] for f in ordered] == ["side_boundary", "pial_boundary", "gray_white_boundary", "exclusion"]
    assert ordered[1]["properties"] == {
        "role": "pial_boundary", "annotation_role": "pia", "tissue_piece_id": "piece_a", "piece_mode": "depth", "dataset": "XENIUM"}
    assert ordered[1]["geometry"] == {"type": "LineString", "coordinates": [[100.0, 200.0], [150.0, 205.0], [200.0, 215.0]]}
    assert ordered[3]["geometry"]["coordinates"][0][0] == ordered[3]["geometry"]["coordinates"][0][-1]

    files.write_annotations(features, found, str(tmp_path / "all"))
    (one,) = (tmp_path / "all" / "section=s").glob("part-*")
    assert [f["properties"]["role"] for f in json.loads(one.read_text())["features"]] == [f["properties"]["role"] for f in ordered]
    files.write_annotations_by_role(features, found, str(tmp_path / "roles"))
    stems = {p.name for p in (tmp_path / "roles" / "section=s").iterdir()}
    assert stems == {"stem=pial_boundary", "stem=wm_boundary", "stem=side_boundaries", "stem=exclusion_masks"}


def test_pial_only_piece(spark):
    _u, merged, _f, errors, _w = judged(drawn(spark, side=[U], pia=[("surface", [[10, 0], [10, 100]])]))
    assert not errors
    assert n.piece_mode(merged).first().piece_mode == "mask_qc_only"


def test_near_snapped_ends_on_an_overhanging_edge(spark):
    edge = [[-20, 0], [80, 0], [80, 100], [-20, 100]]
    _u, _m, _f, errors, _w = judged(drawn(
        spark, side=[edge], pia=[("a", [[10, 0.0001], [10, 100]])], wm=[("a", [[50, 0], [50, 100.0001]])]))
    assert not errors


def test_failures(spark, tmp_path):
    usable, merged, found, errors, _ = judged(drawn(spark, side=[U], wm=[("a", [[30, 0], [30, 100]])]))
    assert errors == {"wm_without_pia"}
    features = n.annotation_features(usable, merged)
    with pytest.raises(ValueError, match="a has a wm line without a pia line"):
        files.write_annotations(features, found, str(tmp_path / "no"))
    files.write_annotations(features, found, str(tmp_path / "forced"), allow_invalid=True, include_validation_report=True)
    (one,) = (tmp_path / "forced" / "section=s").glob("part-*")
    report = json.loads(one.read_text())["validation"]
    assert report["ok"] is False and "without a pia line" in report["errors"][0]

    two = drawn(spark, side=[[[0, 0], [50, 0]], [[0, 100], [50, 100]]], pia=[[[10, 0], [10, 100]]])
    assert "multiple_edges" in judged(two)[3]


def test_crossing_lines_and_touching_exclusion(spark):
    closed = [[0, 0], [0, 100], [100, 100], [100, 0], [0, 0]]
    _u, _m, _f, errors, warnings = judged(drawn(
        spark, side=[closed], pia=[[[0, 0], [100, 100]]], wm=[[[100, 0], [0, 100]]],
        exclusion=[[[20, 20], [20, 40], [40, 40], [40, 20]]]))
    assert "no_ribbon" in errors
    assert {"boundaries_cross", "exclusion_touches"} <= warnings


def test_exclusion_around_a_whole_line(spark):
    df = n.canonical(drawn(spark, pia=[[[10, 10], [12, 12]]], exclusion=[[[0, 0], [0, 50], [50, 50], [50, 0]], [[100, 100], [100, 150], [150, 150]]]))
    assert [r.shape_ord for r in n.exclusion_contacts(df).collect()] == [0]


def test_closed_edge_gives_two_ways(spark):
    closed = [[0, 0], [0, 100], [50, 100], [50, 0], [0, 0]]
    df = n.canonical(drawn(spark, side=[closed], pia=[[[10, 0], [10, 100]]]))
    merged, _ = n.merge_piece_lines(df)
    ribbons, found = n.ribbon_from_edge(merged, df)
    assert [r.rule for r in found.collect()] == ["pial_only_ribbon"] and ribbons.count() == 0


def test_two_ribbons_of_a_piece_and_the_smaller_one(spark):
    square = [[0, 0], [100, 0], [100, 100], [0, 100], [0, 0]]
    around = [[50, 0], [50, -20], [120, -20], [120, 120], [50, 120], [50, 100]]
    df = n.canonical(drawn(spark, side=[square], pia=[[[0, 30], [100, 30]]], wm=[around]))
    merged, _ = n.merge_piece_lines(df)
    ribbons, found = n.ribbon_from_edge(merged, df)
    assert [(r.rule, r.severity) for r in found.collect()] == [("several_ribbons", "warning")]
    row = ribbons.first()
    assert row.candidates == 2 and abs(row.area - 7800) < 1e-6 and row.ring[0] == row.ring[-1]


def test_ribbons_store_no_edge_per_piece(spark, monkeypatch):
    stored = []
    keep = n.materialize
    monkeypatch.setattr(n, "materialize", lambda df: stored.append(df.columns) or keep(df))
    test_closed_edge_gives_two_ways(spark)
    assert sum("_v" in c or "edge" in c for c in stored) == 1
    assert all("piece" not in c for c in stored if "_v" in c or "edge" in c)


def test_explicit_ribbon_skips_edge_checks(spark):
    df = drawn(spark, side=[U], pia=[("a", [[30, 20], [30, 60]])], ribbon=[("a", [[30, 20], [30, 60], [40, 60], [40, 20]])])
    _u, _m, _f, errors, warnings = judged(df)
    assert not errors and "endpoint_gap" not in warnings


def test_gap_message(spark):
    df = n.canonical(drawn(spark, side=[U], pia=[("a", [[10, 27], [10, 100]])]))
    (row,) = n.endpoint_gap_findings(n.endpoint_gaps(df)).collect()
    assert row.message == "a: the start of the pia does not lie on the tissue edge; it is this far off: 27"


def test_snap(spark):
    snapped, errors = n.snap_to_edge(n.canonical(drawn(spark, side=[U], pia=[[[5, 2], [5, 98]]], wm=[[[40, 2], [40, 98]]])))
    got = {r.role: [(v.y, v.x) for v in r.vertices] for r in snapped.collect()}
    assert got == {"pia": [(5.0, 0.0), (5.0, 100.0)], "wm": [(40.0, 0.0), (40.0, 100.0)]} and errors.count() == 0
    assert n.snap_to_edge(n.canonical(drawn(spark, pia=[[[5, 2], [5, 98]]])))[1].first().rule == "missing_edge"


def test_merge(spark):
    df = n.canonical(drawn(spark, pia=[("a", [[0, 0], [0, 10]]), ("a", [[0, 20], [0, 10]]), ("b", [[0, 0], [0, 10]]), ("b", [[0, 20], [0, 30]])]))
    merged, found = n.merge_piece_lines(df)
    assert [[(v.x, v.y) for v in r.vertices] for r in merged.collect()] == [[(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]]
    assert {(r.piece, r.rule) for r in found.collect()} == {("a", "merged_segments"), ("b", "unmergeable_segments")}


OBJECT = "section string, object_type string, object_id string, shape_ord bigint, vertices array<struct<x:double,y:double>>"


def objects(spark, *rows):
    square = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]
    return spark.createDataFrame(
        [("s", kind, ident, k, None if ident == "empty" else [(x + 10.0 * k, y) for x, y in square]) for kind, ident, k in rows], OBJECT)


def test_objects_round_trip(spark, tmp_path):
    df = objects(spark, ("Amyloid plaques", "plaque_a", 0), ("Amyloid plaques", None, 1), ("Tau tangles", None, 0))
    features, found = n.object_features(df, "XENIUM")
    assert found.count() == 0
    files.write_objects(features, found, str(tmp_path / "out"))
    (one,) = (tmp_path / "out" / "section=s").glob("part-*")
    assert json.loads(one.read_text())["object_annotation_schema"]
    path = tmp_path / "objects.geojson"
    path.write_text(one.read_text())
    back = {(r.object_type, r.object_id) for r in files.read_object_annotations(spark, str(path)).collect()}
    assert back == {("Amyloid plaques", "plaque_a"), ("Amyloid plaques", "amyloid_plaques_0002"), ("Tau tangles", "tau_tangles_0001")}


def test_object_findings(spark):
    df = objects(spark, ("Plaques", "same", 0), ("Plaques", "same", 1), ("  ", None, 2), ("None", "empty", 3))
    features, found = n.object_features(df)
    assert {r.rule for r in found.collect()} == {"duplicate_id", "blank_name", "empty_set"}
    assert features.count() == 1
    assert "no_objects" in {r.rule for r in n.object_features(objects(spark, ("None", "empty", 0)))[1].collect()}


def greedy(ids):
    """Numbers given one after the other, skipping every id that is given anywhere."""
    seen, out = {i for i in ids if i}, []
    for k, own in enumerate(ids, start=1):
        while not own and (f"a_{k:04d}" in seen):
            k += 1
        out.append(own or f"a_{k:04d}")
        seen.add(out[-1])
    return out


@pytest.mark.parametrize("ids", [
    [None, None], ["a_0002", None], [None, "a_0003", None, None], ["a_0002", "a_0003", None, None, "own", None],
    [None, None, "a_0001", "a_0002", None], ["a_0005", None, None, None, None, None, "a_0007", None]])
def test_generated_ids(spark, ids):
    df = objects(spark, *[("A", i, k) for k, i in enumerate(ids)])
    got = [r.object_id for r in n.object_ids(df).orderBy("shape_ord").collect()]
    assert got == greedy(ids)


def test_bad_geojson(spark, tmp_path):
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]], [[5, 2], [6, 2], [6, 3], [5, 2]]]}
    bow = {"type": "Polygon", "coordinates": [[[0, 0], [9, 9], [9, 0], [0, 8], [0, 0]]]}
    for name, geometry in (("holes", hole), ("invalid_geometry", bow), ("not_polygon", {"type": "Point", "coordinates": [1, 2]})):
        path = tmp_path / f"{name}.geojson"
        Path(path).write_text(json.dumps(geometry))
        with pytest.raises(ValueError, match=name):
            files.read_object_annotations(spark, str(path))


def test_streams_equal_batch(spark, tmp_path):
    from cytoplane.operators import transcripts as t

    batch = spark.range(200).select(
        F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("gene"), F.col("id").cast("double").alias("x"),
        F.lit(1.0).alias("y"), (F.col("id") % 3).alias("assignment"))
    batch.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = st.read_arriving(spark, str(tmp_path / "in"), batch.schema, max_files=2)
    for name, running, want in (
        ("genes", st.stream_gene_counts(stream), t.gene_counts(batch)),
        ("cells", st.stream_cell_gene_counts(stream), t.cell_gene_counts(batch)),
    ):
        st.write_batches(running, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == sorted(map(tuple, want.collect()))
    for _ in range(2):  # a second run finds nothing new and must not count twice
        st.merge_cell_gene_counts(stream, str(tmp_path / "merge"), str(tmp_path / "merge-cp")).awaitTermination()
    assert sorted(map(tuple, st.merged_totals(spark, str(tmp_path / "merge")).collect())) == sorted(map(tuple, t.cell_gene_counts(batch).collect()))


def test_long_chains_are_merged(spark):
    """A piece of 100,000 segments in any order and direction; a ring; a path with a ring beside it."""
    n_parts = 100_000
    path = spark.range(n_parts).select(
        F.lit("s").alias("section"), F.lit("pia").alias("role"), F.lit("long").alias("piece"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("shape_ord"),
        F.array(F.col("id"), F.col("id") + 1).alias("ends"))
    square = spark.createDataFrame([("ring", k, [k, (k + 1) % 4]) for k in range(4)] + [("two", k, [k, k + 1]) for k in range(3)] +
                                   [("two", 10 + k, [10 + k, 10 + (k + 1) % 3]) for k in range(3)], "piece string, shape_ord long, ends array<long>")
    rows = path.unionByName(square.select(F.lit("s").alias("section"), F.lit("pia").alias("role"), "*"))
    turned = F.when(F.xxhash64("ends") % 2 == 0, F.reverse("ends")).otherwise(F.col("ends"))
    shapes = rows.withColumn("vertices", F.transform(turned, lambda v: F.struct(v.cast("double").alias("x"), F.lit(1.0).alias("y")))).drop("ends").repartition(8)
    merged, found = n.merge_piece_lines(shapes)
    got = {r.piece: r for r in merged.collect()}
    assert set(got) == {"long", "ring"} and got["long"].parts == n_parts
    xs = [v.x for v in got["long"].vertices]
    assert xs in (list(map(float, range(n_parts + 1))), list(map(float, range(n_parts, -1, -1))))
    ring = [v.x for v in got["ring"].vertices]
    assert len(ring) == 5 and ring[0] == ring[-1] and sorted(ring[:4]) == [0.0, 1.0, 2.0, 3.0]
    assert {(r.piece, r.rule) for r in found.collect()} == {("long", "merged_segments"), ("ring", "merged_segments"), ("two", "unmergeable_segments")}


def test_rings_are_judged_alike_in_their_row_and_on_the_grid(spark, monkeypatch):
    rings = {
        "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "bow": [(0, 0), (4, 4), (4, 0), (0, 4)], "spike": [(0, 0), (4, 0), (8, 0), (4, 0), (4, 4)],
        "touch": [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], "triangle": [(0, 0), (4, 0), (0, 4)], "flat": [(0, 0), (4, 0), (2, 0)],
        "stairs": [p for k in range(20) for p in ((k, k), (k + 1, k))] + [(20, 20), (0, 20)],
    }
    shapes = spark.createDataFrame(
        [(k, [(float(x), float(y)) for x, y in v]) for k, v in rings.items()], "name string, vertices array<struct<x:double,y:double>>")
    met = []
    meeting = n.meeting_boxes
    monkeypatch.setattr(n, "meeting_boxes", lambda a, *rest: met.append({q.name for q in a.select("name").collect()}) or meeting(a, *rest))
    found = {q.name for q in n._self_touching(shapes, ["name"]).collect()}
    monkeypatch.setattr(n, "SHORT_RING", 0)
    assert found == {q.name for q in n._self_touching(shapes, ["name"]).collect()} == {"bow", "spike", "touch", "flat"}
    assert met == [{"stairs"}, set(rings)]


def test_equal_polygons_are_compared_once(spark, monkeypatch):
    def square(at, side):
        return [(float(x), float(y)) for x, y in ((at, 0), (at + side, 0), (at + side, side), (at, side))]

    rows = [("s", f"p{k}", square(0, 4)) for k in range(6)] + [("s", "q", square(3, 4)), ("s", "q", square(0, 4)), ("s", "far", square(50, 4)), ("t", "p0", square(0, 4))]
    polygons = spark.createDataFrame([*rows, ("s", None, square(0, 4))], "section string, piece string, vertices array<struct<x:double,y:double>>")
    sent = []
    meeting = n.meeting_boxes
    monkeypatch.setattr(n, "meeting_boxes", lambda a, *rest: sent.append(a.count()) or meeting(a, *rest))
    got = [(q.section, q.left_piece, q.right_piece) for q in n.piece_overlaps(polygons).collect()]
    names = [f"p{k}" for k in range(6)] + ["q"]
    assert sorted(got) == [("s", a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    assert sent == [4]
