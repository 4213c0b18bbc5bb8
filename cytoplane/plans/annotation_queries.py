"""Queries over tissue and object annotations, their files, and the streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.operators import annotations as n
from cytoplane.plans import adapters as a
from cytoplane.plans.adapters import oracle
from cytoplane.plans.registry import query, scratch
from cytoplane.sources import annotations as files
from cytoplane.streaming import counts as st
from cytoplane.streaming.versions import Versions, read_versions, write_versions


def _shapes(spark, sf):
    return n.canonical(a.annotations(spark, sf))


def _xy(x, y):
    return g.vertex(x, y)


def _drawn_lines(spark, sf):
    """One line per customer, some of them broken on purpose."""
    c = a.table(spark, sf, "customer")
    k, x = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    far = F.when(k % 13 == 0, x).otherwise(x + 10)
    first, last = _xy(x, F.lit(0.0)), _xy(far, F.lit(0.0))
    bent = _xy(x + 5, F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.lit(3.0)))
    shape = F.when(k % 13 == 0, F.array(first, first)).when(k % 5 == 0, F.array(first, bent, first)).otherwise(F.array(first, bent, last))
    return c.select(
        F.col("c_mktsegment").alias("section"), F.when(k % 2 == 0, "pia").otherwise("side").alias("role"),
        F.col("c_name").alias("piece"), k.alias("shape_ord"), shape.alias("vertices")).withColumn("vertices", F.expr(g.drop_repeats("vertices")))


@query(f"""
    SELECT c_mktsegment AS section, c_name AS piece, role, k AS shape_ord, 'error' AS severity, rule,
           CASE role WHEN 'pia' THEN 'Pial boundary' ELSE 'Tissue edge boundary' END || ' shape ' || (k + 1) ||
           CASE rule WHEN 'too_few_points' THEN '{n.TEXTS["line_points"]}' WHEN 'non_finite' THEN '{n.TEXTS["non_finite"]}'
                     ELSE '{n.TEXTS["closed_line"]}' END AS message
    FROM (SELECT *, CASE WHEN k % 13 = 0 THEN 'too_few_points' WHEN k % 17 = 0 THEN 'non_finite' WHEN k % 5 = 0 AND k % 2 = 0 THEN 'closed_line' END AS rule
          FROM (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'pia' ELSE 'side' END AS role FROM customer) AS p) AS q
    WHERE rule IS NOT NULL""")
def check_lines(spark, sf):
    return n.check_lines(_drawn_lines(spark, sf))


@query(f"""
    SELECT c_mktsegment AS section, c_name AS piece, 'ribbon' AS role, k AS shape_ord, 'error' AS severity, rule,
           'Cortical ribbon shape ' || (k + 1) || CASE rule WHEN 'too_few_points' THEN '{n.TEXTS["polygon_points"]}'
             WHEN 'zero_area' THEN '{n.TEXTS["zero_area"]}' WHEN 'non_finite' THEN '{n.TEXTS["non_finite"]}'
             ELSE '{n.TEXTS["self_intersecting"]}' END AS message
    FROM (SELECT *, CASE WHEN k % 13 = 0 THEN 'too_few_points' WHEN k % 17 = 0 THEN 'non_finite' WHEN k % 11 = 0 THEN 'zero_area'
                         WHEN k % 7 = 0 OR k % 5 = 0 THEN 'self_intersecting' END AS rule
          FROM (SELECT *, c_custkey AS k FROM customer) AS p) AS q WHERE rule IS NOT NULL""")
def check_polygons(spark, sf):
    c = a.table(spark, sf, "customer")
    k, x = F.col("c_custkey"), F.col("c_nationkey").cast("double")
    p00, p10, p11, p01 = _xy(x, F.lit(0.0)), _xy(x + 10, F.lit(0.0)), _xy(x + 10, F.lit(10.0)), _xy(x, F.lit(10.0))
    bad = _xy(x, F.lit(float("nan")))
    spike = _xy(x + 10, F.lit(5.0))
    shape = (
        F.when(k % 13 == 0, F.array(p00, p10, p10)).when(k % 17 == 0, F.array(p00, p10, bad))
        .when(k % 11 == 0, F.array(p00, p10, _xy(x + 4, F.lit(0.0)))).when(k % 7 == 0, F.array(p00, p11, p10, _xy(x, F.lit(12.0))))
        .when(k % 5 == 0, F.array(p00, p10, p11, spike, p01)).otherwise(F.array(p00, p10, p11, p01))
    )
    return n.check_polygons(c.select(
        F.col("c_mktsegment").alias("section"), F.lit("ribbon").alias("role"), F.col("c_name").alias("piece"),
        k.alias("shape_ord"), shape.alias("vertices")).withColumn("vertices", F.expr(g.drop_repeats("vertices"))))


@query("""
    SELECT 'all' AS section, c_name AS piece, CAST(2 + (c_custkey % 2) AS BIGINT) AS parts, CAST(3 + (c_custkey % 2) AS BIGINT) AS n_vertices,
           CAST(c_custkey % 2 AS DOUBLE) * 10 + 20 AS length, 'warning' AS severity
    FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT 'all', c_name, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 'error' FROM customer WHERE c_custkey % 3 = 0""")
def merge_piece_lines(spark, sf):
    """Two or three segments per piece; every third piece has a gap and cannot be merged."""
    c = a.table(spark, sf, "customer")
    k = F.col("c_custkey")
    shift = F.when(k % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0))

    def line(order, x0, x1, dx=0.0):
        return F.struct(F.lit(order).cast("bigint").alias("shape_ord"), F.array(_xy(F.lit(x0) + dx, k), _xy(F.lit(x1) + dx, k)).alias("vertices"))

    base = F.array(line(0, 10.0, 0.0), line(1, 10.0, 20.0, shift))
    parts = F.when(k % 2 == 0, base).otherwise(F.concat(base, F.array(line(2, 30.0, 20.0, shift))))
    rows = c.select(F.lit("all").alias("section"), F.lit("pia").alias("role"), F.col("c_name").alias("piece"), F.explode(parts).alias("p"))
    merged, found = n.merge_piece_lines(rows.select("section", "role", "piece", "p.shape_ord", "p.vertices"))
    sized = merged.select("section", "piece", "parts", F.size("vertices").cast("bigint").alias("n_vertices"), F.expr(g.line_length("vertices")).alias("length"))
    return found.select("section", "piece", "severity").join(sized, ["section", "piece"], "left").select(
        "section", "piece", "parts", "n_vertices", "length", "severity")


_LINE_ENDS = """
    SELECT section, role, piece, vertex_ord, x, y, x AS sx, y AS sy FROM annotations_v WHERE role IN ('pia', 'wm')"""


@query(oracle("""
    SELECT a.section, role, piece, CAST(vertex_ord AS BIGINT) AS vertex_ord,
           round(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN x ELSE 1000 END, 6) AS x,
           round(CASE WHEN d0 <= d1 AND d0 <= d2 THEN y WHEN d1 <= d2 THEN 0 ELSE y END, 6) AS y
    FROM (SELECT *, abs(x) AS d0, abs(y) AS d1, abs(1000 - x) AS d2 FROM annotations_v WHERE role IN ('pia', 'wm')) AS a
    WHERE section IN (SELECT section FROM annotations_v WHERE role = 'side' GROUP BY section HAVING count(DISTINCT shape_ord) = 1)""", "annotations_v"))
def snap_to_edge(spark, sf):
    snapped, _errors = n.snap_to_edge(_shapes(spark, sf))
    rows = snapped.select("section", "role", "piece", F.posexplode("vertices").alias("vertex_ord", "v"))
    return rows.select("section", "role", "piece", F.col("vertex_ord").cast("bigint").alias("vertex_ord"),
                       F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"))


@query(oracle("""
    SELECT section, 'multiple_edges' AS rule FROM annotations_v WHERE role = 'side' GROUP BY section HAVING count(DISTINCT shape_ord) > 1""", "annotations_v"))
def snap_to_edge_errors(spark, sf):
    return n.snap_to_edge(_shapes(spark, sf))[1].select("section", "rule")


@query(oracle("""
    SELECT section, piece, CASE WHEN bool_or(role = 'wm') THEN 'depth' ELSE 'mask_qc_only' END AS piece_mode
    FROM annotations_v WHERE piece IS NOT NULL GROUP BY section, piece HAVING bool_or(role = 'pia')""", "annotations_v"))
def piece_mode(spark, sf):
    return n.piece_mode(_shapes(spark, sf))


@query(oracle("SELECT DISTINCT section, piece FROM annotations_v WHERE role <> 'side'", "annotations_v"))
def piece_ids(spark, sf):
    return n.piece_ids(_shapes(spark, sf))


@query(oracle("""
    SELECT section, CAST(NULL AS VARCHAR) AS piece, 'multiple_edges' AS rule FROM annotations_v WHERE role = 'side' GROUP BY section HAVING count(DISTINCT shape_ord) > 1
    UNION ALL
    SELECT section, piece, CASE WHEN bool_or(role = 'wm') THEN 'wm_without_pia' ELSE 'polygons_without_pia' END
    FROM annotations_v WHERE piece IS NOT NULL GROUP BY section, piece HAVING NOT bool_or(role = 'pia')""", "annotations_v"))
def piece_rule_errors(spark, sf):
    return n.piece_rule_errors(_shapes(spark, sf)).select("section", "piece", "rule")


@query(oracle("""
    SELECT r_name AS section, n_name AS piece FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (5, 14, 23)"""))
def boundary_crossings(spark, sf):
    return n.boundary_crossings(_shapes(spark, sf)).select("section", "piece")


@query(oracle("""
    SELECT r_name AS section, n_name AS piece, CAST(0 AS BIGINT) AS shape_ord FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 12 = 0"""))
def exclusion_contacts(spark, sf):
    return n.exclusion_contacts(_shapes(spark, sf)).select("section", "piece", "shape_ord")


@query(oracle("""
    SELECT e.section, e.piece, role, CASE WHEN vertex_ord = 0 THEN 'start' ELSE 'end' END AS "end",
           round(least(x, abs(y), 1000 - x), 6) AS distance, round(tolerance, 6) AS tolerance
    FROM annotations_v AS e JOIN
      (SELECT section, piece, 0.02 * max(len) AS tolerance FROM
        (SELECT section, piece, role, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS len FROM annotations_v WHERE role IN ('pia', 'wm') GROUP BY ALL) AS q
       GROUP BY section, piece HAVING bool_or(role = 'pia')) AS t ON t.section = e.section AND t.piece = e.piece
    WHERE e.role IN ('pia', 'wm') AND least(x, abs(y), 1000 - x) > tolerance
      AND e.section IN (SELECT section FROM annotations_v WHERE role = 'side' GROUP BY section HAVING count(DISTINCT shape_ord) = 1)""", "annotations_v"))
def endpoint_gaps(spark, sf):
    gaps = n.endpoint_gaps(_shapes(spark, sf))
    return gaps.withColumns({"distance": F.round("distance", 6), "tolerance": F.round("tolerance", 6)})


@query("""
    SELECT section, piece, CASE WHEN rule IS NULL THEN CAST(1 AS BIGINT) END AS candidates, CASE WHEN rule IS NULL THEN CAST(area AS DOUBLE) END AS area, rule FROM
      (SELECT CASE WHEN k % 4 < 2 THEN 'open' ELSE 'closed' END AS section, c_name AS piece,
              100 * (CASE k % 4 WHEN 0 THEN 55 WHEN 1 THEN 60 ELSE 90 END - (10 + k % 40)) AS area,
              CASE WHEN k % 4 = 3 OR k % 20 = 1 THEN 'pial_only_ribbon' END AS rule
       FROM (SELECT c_custkey AS k, c_name FROM customer) AS c) AS q
    UNION ALL
    SELECT 'crossed', c_name, CASE WHEN told = 0 THEN CAST(2 AS BIGINT) END,
           CASE WHEN told = 0 THEN CAST(4800 + 100 * (10 + c_custkey % 40) AS DOUBLE) END, CASE WHEN told = 1 THEN 'several_ribbons' END
    FROM customer CROSS JOIN (VALUES (0), (1)) AS t(told) WHERE c_custkey % 10 = 0""")
def ribbon_from_edge(spark, sf):
    """An open and two closed edges; pieces with one ribbon, with none (the pia lies on the edge), with two of a pia alone,
    and with two of a pia within the edge and a wm that runs outside of it, of which the smaller is taken."""
    c = a.table(spark, sf, "customer")
    k = F.col("c_custkey")
    section, level = F.when(k % 4 < 2, F.lit("open")).otherwise(F.lit("closed")), (10 + k % 40).cast("double")

    def at(*points):
        return F.array(*[_xy(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    def across(y):
        return F.array(_xy(F.lit(0.0), y), _xy(F.lit(100.0), y))

    drawn = F.when(F.col("section") == "open", at((0, -20), (0, 60), (100, 60), (100, -20))).otherwise(at((0, 0), (100, 0), (100, 100), (0, 100), (0, 0)))
    edge = c.select(section.alias("section")).distinct().select("section", F.lit("side").alias("role"), F.lit(None).cast("string").alias("piece"), drawn.alias("vertices"))
    line = F.when(k % 20 == 1, at((0, 10), (0, 30))).otherwise(across(level))
    pia = c.select(section.alias("section"), F.lit("pia").alias("role"), F.col("c_name").alias("piece"), line.alias("vertices"))
    low = across(F.when(k % 4 == 0, F.lit(55.0)).otherwise(F.lit(90.0)))
    wm = c.filter(k % 2 == 0).select(section.alias("section"), F.lit("wm").alias("role"), F.col("c_name").alias("piece"), low.alias("vertices"))
    crossed = c.filter(k % 10 == 0).select(F.lit("crossed").alias("section"), F.col("c_name").alias("piece"), across(level).alias("pia"))
    inside = crossed.select("section", F.lit("pia").alias("role"), "piece", F.col("pia").alias("vertices"))
    around = at((50, 0), (50, -20), (120, -20), (120, 120), (50, 120), (50, 100))
    outside = crossed.select("section", F.lit("wm").alias("role"), "piece", around.alias("vertices"))
    square = at((0, 0), (100, 0), (100, 100), (0, 100), (0, 0))
    rim = crossed.select("section").distinct().select("section", F.lit("side").alias("role"), F.lit(None).cast("string").alias("piece"), square.alias("vertices"))
    parts = [pia, wm, inside, outside, rim]
    shapes = reduce(DataFrame.unionByName, parts, edge).withColumn("shape_ord", F.lit(0).cast("bigint"))
    merged, _ = n.merge_piece_lines(shapes)
    ribbons, found = n.ribbon_from_edge(merged, shapes)
    told = found.select("section", "piece", F.lit(None).cast("bigint").alias("candidates"), F.lit(None).cast("double").alias("area"), "rule")
    return ribbons.select("section", "piece", "candidates", F.round("area", 6).alias("area"), F.lit(None).cast("string").alias("rule")).union(told)


@query(oracle("""
    SELECT l.s AS section, CAST(l.cell_id AS VARCHAR) AS left_piece, CAST(k.cell_id AS VARCHAR) AS right_piece
    FROM (SELECT *, s_nationkey % 3 AS s FROM cells_v) AS l JOIN (SELECT *, s_nationkey % 3 AS s FROM cells_v) AS k
      ON l.s = k.s AND CAST(l.cell_id AS VARCHAR) < CAST(k.cell_id AS VARCHAR)
    WHERE CASE WHEN l.sq AND k.sq THEN greatest(abs(l.cx - k.cx), abs(l.cy - k.cy)) < l.w + k.w
               WHEN NOT l.sq AND NOT k.sq THEN abs(l.cx - k.cx) + abs(l.cy - k.cy) < l.w + k.w
               WHEN l.sq THEN greatest(abs(l.cx - k.cx) - l.w, 0) + greatest(abs(l.cy - k.cy) - l.w, 0) < k.w
               ELSE greatest(abs(l.cx - k.cx) - k.w, 0) + greatest(abs(l.cy - k.cy) - k.w, 0) < l.w END""", "cells_v"))
def piece_overlaps(spark, sf):
    """Cells stand in for ribbons: diamonds and squares overlap by a closed form."""
    kind = a.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("cell_id"), (F.col("s_nationkey") % 3).alias("s"))
    shapes = a.cells(spark, sf).join(kind, "cell_id").select(
        F.col("s").alias("section"), F.col("cell_id").alias("piece"), F.col("parts")[0]["exterior"].alias("vertices"))
    return n.piece_overlaps(shapes.withColumn("vertices", F.slice("vertices", 1, 4)))


_ROLES = "CASE role WHEN 'side' THEN 'side_boundary' WHEN 'pia' THEN 'pial_boundary' WHEN 'wm' THEN 'gray_white_boundary' ELSE 'exclusion' END"
_FEATURES = f"""
    SELECT section, coalesce(piece, '') AS ord_piece, role,
           '{{"type":"Feature","properties":{{"role":"' || {_ROLES} || '","annotation_role":"' || role || '"' ||
           coalesce(',"tissue_piece_id":"' || piece || '","piece_mode":"' || mode || '"', '') || ',"dataset":"demo"}},"geometry":{{"type":"' ||
           CASE WHEN role = 'exclusion' THEN 'Polygon","coordinates":[[' || path || ',' || head || ']]' ELSE 'LineString","coordinates":[' || path || ']' END || '}}}}' AS feature
    FROM (SELECT a.section, a.role, a.piece, m.mode, string_agg('[' || x || ',' || y || ']', ',' ORDER BY vertex_ord) AS path,
                 arg_min('[' || x || ',' || y || ']', vertex_ord) AS head
          FROM annotations_v AS a LEFT JOIN
            (SELECT section, piece, CASE WHEN bool_or(role = 'wm') THEN 'depth' ELSE 'mask_qc_only' END AS mode
             FROM annotations_v WHERE piece IS NOT NULL GROUP BY section, piece HAVING bool_or(role = 'pia')) AS m ON m.section = a.section AND m.piece = a.piece
          WHERE (a.role <> 'side' AND m.mode IS NOT NULL)
             OR (a.role = 'side' AND a.section IN (SELECT section FROM annotations_v WHERE role = 'side' GROUP BY section HAVING count(DISTINCT shape_ord) = 1))
          GROUP BY a.section, a.role, a.piece, m.mode, a.shape_ord) AS q"""


def _features(spark, sf):
    usable, merged, found = n.check_annotations(a.annotations(spark, sf))
    return n.annotation_features(usable, merged, "demo"), found


@query(oracle(_FEATURES, "annotations_v"))
def annotation_features(spark, sf):
    shapes = _shapes(spark, sf)
    merged, _ = n.merge_piece_lines(shapes)
    return n.annotation_features(shapes, merged, "demo").select("section", "ord_piece", "role", "feature")


@query(oracle("""
    SELECT r_name AS section, n_name AS piece, rule, severity FROM nation JOIN region ON n_regionkey = r_regionkey JOIN
      (SELECT n_nationkey AS k, 'boundaries_cross' AS rule, 'warning' AS severity FROM nation WHERE n_nationkey IN (5, 14, 23)
       UNION ALL SELECT n_nationkey, 'exclusion_touches', 'warning' FROM nation WHERE n_nationkey % 12 = 0
       UNION ALL SELECT n_nationkey, 'endpoint_gap', 'warning' FROM nation WHERE n_nationkey % 5 = 3 AND n_regionkey <> 4
       UNION ALL SELECT n_nationkey, 'no_ribbon', 'error' FROM nation WHERE n_nationkey IN (5, 23)
       UNION ALL SELECT n_nationkey, 'wm_without_pia', 'error' FROM nation WHERE n_nationkey = 7) AS f ON f.k = n_nationkey
    UNION ALL SELECT r_name, CAST(NULL AS VARCHAR), 'multiple_edges', 'error' FROM region WHERE r_regionkey = 4
    UNION ALL SELECT r_name, CAST(NULL AS VARCHAR), 'pieces_overlap', 'warning'
    FROM nation AS low JOIN nation AS high ON low.n_regionkey = high.n_regionkey AND low.n_nationkey < high.n_nationkey JOIN region ON high.n_regionkey = r_regionkey
    WHERE high.n_nationkey % 4 = 0 AND low.n_nationkey NOT IN (5, 7, 23) AND r_regionkey <> 4""", "annotations_v"))
def check_annotations(spark, sf):
    """All rules at once."""
    _usable, _merged, found = n.check_annotations(a.annotations(spark, sf))
    return found.select("section", "piece", "rule", "severity")


@query(oracle("""
    SELECT DISTINCT section, role, CAST(shape_ord AS BIGINT) AS shape_ord,
           CASE WHEN role <> 'side' AND length(piece) % 2 = 0 THEN 'moved_' || piece ELSE piece END AS tissue_piece_id
    FROM annotations_v""", "annotations_v"))
def relabel_pieces(spark, sf):
    drawn = a.annotations(spark, sf)
    updates = drawn.filter(F.length("tissue_piece_id") % 2 == 0).select(
        "section", "role", "shape_ord", "tissue_piece_id", F.concat(F.lit(" moved_"), "tissue_piece_id").alias("new_piece_id"))
    return n.relabel_pieces(drawn, updates).select("section", "role", "shape_ord", "tissue_piece_id")


@query("""
    SELECT vec_id, count(*) AS n_kept, CAST(sum(v * (p + 1)) AS DOUBLE) AS weighted FROM
      (SELECT vec_id, v, p, lag(v) OVER (PARTITION BY vec_id ORDER BY p) AS before FROM
        (SELECT vec_id, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 2) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) AS q) AS r
    WHERE before IS NULL OR before <> v GROUP BY vec_id""")
def drop_repeat_vertices(spark, sf):
    """Vertices carry their place as a second number through ``floor``, so kept ones can be told apart."""
    e = a.table(spark, sf, "embeddings")
    line = F.transform("embedding", lambda v: _xy(F.floor(v.cast("double") * 2), F.lit(0.0)))
    lines = n.drop_repeat_vertices(e.select("vec_id", line.alias("vertices")))
    whole = e.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 2)).alias("w"))
    firsts = whole.select("vec_id", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (
        F.get("w", i) != F.get("w", i - 1))).alias("at"))
    joined = lines.join(firsts, "vec_id")
    total = F.aggregate(F.arrays_zip("vertices", "at"), F.lit(0.0), lambda s, z: s + z["vertices"]["x"] * (z["at"] + 1))
    return joined.select("vec_id", F.size("vertices").cast("bigint").alias("n_kept"), total.alias("weighted"))


_OBJECTS = """
    SELECT n_name AS section, 'Set ' || (s_suppkey % 2) AS object_type, s_suppkey AS shape_ord,
           row_number() OVER (PARTITION BY n_name, s_suppkey % 2 ORDER BY s_suppkey) AS idx,
           CASE WHEN s_suppkey % 7 = 0 THEN 'own_' || CAST(s_suppkey AS VARCHAR(20)) END AS given, 'set_' || (s_suppkey % 2) AS safe
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _objects(spark, sf, clash=False):
    """Named squares; some ids are given, and with ``clash`` one looks like a generated one."""
    s, nn = a.table(spark, sf, "supplier"), a.table(spark, sf, "nation")
    k = F.col("s_suppkey")
    x, y = (k * 10).cast("double"), F.lit(0.0)
    square = F.array(_xy(x, y), _xy(x + 4, y), _xy(x + 4, y + 4), _xy(x, y + 4))
    given = F.when(k % 7 == 0, F.concat(F.lit("own_"), k.cast("string")))
    return s.join(nn, s.s_nationkey == nn.n_nationkey).select(
        F.col("n_name").alias("section"), F.concat(F.lit("Set "), (k % 2).cast("string")).alias("object_type"),
        given.alias("object_id"), k.alias("shape_ord"), square.alias("vertices"))


@query(oracle("""
    SELECT section, object_type, shape_ord, coalesce(given, safe || '_' || lpad(CAST(idx AS VARCHAR), 4, '0')) AS object_id FROM objects_v""", objects_v=_OBJECTS))
def object_ids(spark, sf):
    return n.object_ids(_objects(spark, sf)).select("section", "object_type", "shape_ord", "object_id")


@query(oracle("""
    SELECT section, object_type, shape_ord, coalesce(given, safe || '_' || lpad(CAST(idx AS VARCHAR), 4, '0')) AS object_id,
           '{"type":"Feature","properties":{"role":"analysis_object","annotation_role":"object","object_id":"' ||
           coalesce(given, safe || '_' || lpad(CAST(idx AS VARCHAR), 4, '0')) || '","object_type":"' || object_type || '","name":"' || object_type ||
           '"},"geometry":{"type":"Polygon","coordinates":[[[' || x || ',0.0],[' || x4 || ',0.0],[' || x4 || ',4.0],[' || x || ',4.0],[' || x || ',0.0]]]}}' AS feature
    FROM (SELECT *, CAST(CAST(shape_ord * 10 AS DOUBLE) AS VARCHAR) AS x, CAST(CAST(shape_ord * 10 + 4 AS DOUBLE) AS VARCHAR) AS x4 FROM objects_v) AS q""", objects_v=_OBJECTS))
def object_features(spark, sf):
    features, _found = n.object_features(_objects(spark, sf))
    return features.select("section", "object_type", "shape_ord", "object_id", "feature")


def _documents(spark, sf):
    """One GeoJSON document per supplier: two features, one of them a multipolygon."""
    s = a.table(spark, sf, "supplier")
    k = F.col("s_suppkey")

    def ring(dx):
        x = [(k * 10 + dx + d).cast("string") for d in (0, 4)]
        return F.concat(F.lit("[["), x[0], F.lit(",0],["), x[1], F.lit(",0],["), x[1], F.lit(",4],["), x[0], F.lit(",0]]"))

    ident = F.when(k % 2 == 0, F.concat(F.lit('"object_id":"own_'), k.cast("string"), F.lit('",'))).otherwise(F.lit(""))
    one = F.concat(F.lit('{"type":"Feature","properties":{'), ident, F.lit('"object_type":"'), "s_name", F.lit('"},"geometry":{"type":"Polygon","coordinates":['), ring(0), F.lit("]}}"))
    two = F.concat(F.lit('{"type":"Feature","properties":{"object_id":"m","name":"Multi"},"geometry":{"type":"MultiPolygon","coordinates":[['), ring(10), F.lit("],["), ring(20), F.lit("]]}}"))
    bare = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(0), F.lit("]}"))
    text = F.when(k % 5 == 0, bare).when(k % 5 == 1, one).otherwise(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), one, F.lit(","), two, F.lit("]}")))
    return s.select(k.cast("string").alias("section"), text.alias("text"))


@query("""
    SELECT CAST(k AS VARCHAR) AS section, CASE WHEN k % 5 = 0 THEN 'objects' ELSE s_name END AS object_type,
           CASE WHEN k % 5 = 0 THEN 'objects_0001' WHEN k % 2 = 0 THEN 'own_' || k ELSE lower(regexp_replace(s_name, '[^A-Za-z0-9_.-]+', '_', 'g')) || '_0001' END AS object_id,
           CAST(3 AS BIGINT) AS n_vertices, CAST(k * 10 AS DOUBLE) AS x
    FROM (SELECT s_suppkey AS k, s_name FROM supplier) AS q
    UNION ALL
    SELECT CAST(s_suppkey AS VARCHAR), 'Multi', 'm_' || p, CAST(3 AS BIGINT), CAST(s_suppkey * 10 + 10 * p AS DOUBLE)
    FROM supplier CROSS JOIN (VALUES (1), (2)) AS v(p) WHERE s_suppkey % 5 > 1""")
def scan_object_annotations(spark, sf):
    objects, _errors = files.scan_object_annotations(_documents(spark, sf))
    return objects.select("section", "object_type", "object_id", F.size("vertices").cast("bigint").alias("n_vertices"), F.col("vertices")[0]["x"].alias("x"))


@query("""
    SELECT CAST(s_suppkey AS VARCHAR) AS section, CASE WHEN s_suppkey % 7 > 1 THEN CAST(s_suppkey % 7 = 4 AS BIGINT) END AS feature,
           CASE s_suppkey % 7 WHEN 1 THEN 'no_objects' WHEN 2 THEN 'not_polygon' WHEN 3 THEN 'holes' WHEN 4 THEN 'duplicate_id' WHEN 5 THEN 'invalid_geometry' END AS rule
    FROM supplier WHERE s_suppkey % 7 BETWEEN 1 AND 5""")
def scan_object_errors(spark, sf):
    """One mistake per document, by the supplier's number; every other document has a ring that is left open."""
    square, open_ = "[[0,0],[4,0],[4,4],[0,4],[0,0]]", "[[0,0],[4,0],[4,4],[0,4]]"
    hole, tie = "[[1,1],[2,1],[2,2],[1,1]]", "[[0,0],[4,4],[4,0],[0,5],[0,0]]"

    def feature(kind, coordinates, ident="a"):
        return f'{{"type":"Feature","properties":{{"object_id":"{ident}"}},"geometry":{{"type":"{kind}","coordinates":{coordinates}}}}}'

    bodies = {1: "", 2: feature("Point", "[0,0]"), 3: feature("Polygon", f"[{square},{hole}]"),
              4: feature("Polygon", f"[{square}]") + "," + feature("Polygon", f"[{open_}]"), 5: feature("Polygon", f"[{tie}]")}
    s = a.table(spark, sf, "supplier")
    body = F.lit(feature("Polygon", f"[{open_}]"))
    for rest, text in bodies.items():
        body = F.when(F.col("s_suppkey") % 7 == rest, F.lit(text)).otherwise(body)
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
    return files.scan_object_annotations(s.select(F.col("s_suppkey").cast("string").alias("section"), text.alias("text")))[1]


_READ = "struct<type:string,features:array<struct<type:string,properties:struct<annotation_role:string,tissue_piece_id:string,object_id:string>>>>"


def _read_back(spark, path, *parts):
    """Parse the written collections again, one document per folder."""
    lines = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    names = [F.url_decode(F.regexp_extract("path", f"/{p}=([^/]*)/", 1)).alias(p) for p in parts]
    doc = F.from_json("value", _READ)
    return lines.select(*names, F.explode(doc["features"]).alias("f"))


@query(oracle(f"SELECT section, role, count(*) AS n FROM ({_FEATURES}) AS q GROUP BY section, role", "annotations_v"))
def write_annotations(spark, sf):
    """Written with its report although there are errors, then read back as JSON."""
    features, found = _features(spark, sf)
    path = scratch(spark, "annotations")
    files.write_annotations(features, found, path, allow_invalid=True, include_validation_report=True)
    back = _read_back(spark, path, "section")
    return back.groupBy("section", F.col("f.properties.annotation_role").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(oracle(f"""
    SELECT section, CASE role WHEN 'pia' THEN 'pial_boundary' WHEN 'wm' THEN 'wm_boundary' WHEN 'side' THEN 'side_boundaries' ELSE 'exclusion_masks' END AS stem,
           count(*) AS n FROM ({_FEATURES}) AS q GROUP BY ALL""", "annotations_v"))
def write_annotations_by_role(spark, sf):
    features, found = _features(spark, sf)
    path = scratch(spark, "roles")
    files.write_annotations_by_role(features, found, path, allow_invalid=True)
    return _read_back(spark, path, "section", "stem").groupBy("section", "stem").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("""
    SELECT section, coalesce(given, safe || '_' || lpad(CAST(idx AS VARCHAR), 4, '0')) AS object_id FROM objects_v""", objects_v=_OBJECTS))
def write_objects(spark, sf):
    features, found = n.object_features(_objects(spark, sf))
    path = scratch(spark, "objects")
    files.write_objects(features, found, path)
    return _read_back(spark, path, "section").select("section", F.col("f.properties.object_id").alias("object_id"))


# -- Streams ------------------------------------------------------------------------------------

def _arriving(spark, sf):
    """The events table as arriving transcript files, a few files per batch."""
    schema = a.table(spark, sf, "events").schema
    raw = st.read_arriving(spark, f"{sf}/[e]vents.parquet", schema, max_files=4)
    return raw.select(
        F.col("event_type").alias("feature_name"), F.col("user_id").alias("cell"),
        F.col("value").alias("x_location"), (F.col("event_id") % 1000).cast("double").alias("y_location"))


def _batches(spark, sf, count=3):
    """The same in several files, one for each batch."""
    path = scratch(spark, "arriving")
    a.table(spark, sf, "events").repartition(count, "event_id").write.parquet(path)
    raw = st.read_arriving(spark, path, a.table(spark, sf, "events").schema, max_files=1)
    return raw.select(
        F.col("event_type").alias("gene"), F.col("user_id").alias("assignment"),
        F.col("value").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"))


def _versions(spark, counts, key, name):
    path = scratch(spark, name)
    write_versions(counts, key, f"{path}/table", f"{path}/checkpoint", merge_after=2).awaitTermination()
    return f"{path}/table"


def _canonical(spark, sf):
    from cytoplane.sources.transcripts import canonical_transcripts

    return canonical_transcripts(_arriving(spark, sf))


_EVENTS_VALID = "value IS NOT NULL AND NOT isnan(value) AND abs(value) < CAST('Infinity' AS DOUBLE) AND event_type IS NOT NULL"


@query(f"SELECT event_type AS gene, count(*) AS n FROM events WHERE {_EVENTS_VALID} GROUP BY event_type")
def stream_gene_counts(spark, sf):
    return read_versions(spark, _versions(spark, st.stream_gene_counts(_batches(spark, sf)), ["gene"], "gene-counts"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS cell_id, event_type AS gene, count(*) AS n FROM events WHERE {_EVENTS_VALID} AND user_id > 0 GROUP BY ALL")
def stream_cell_gene_counts(spark, sf):
    counts = st.stream_cell_gene_counts(_batches(spark, sf))
    return read_versions(spark, _versions(spark, counts, ["cell_id", "gene"], "cell-counts"))


@query(f"""
    SELECT CAST(3 AS BIGINT) AS batches, true AS merged, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS points FROM
      (SELECT user_id, event_type, count(*) AS n FROM events WHERE {_EVENTS_VALID} AND user_id > 0 GROUP BY ALL) AS q""")
def stream_cell_gene_versions(spark, sf):
    """Three batches make three versions, the second of which is merged into a base."""
    path = _versions(spark, st.stream_cell_gene_counts(_batches(spark, sf)), ["cell_id", "gene"], "cell-versions")
    now = Versions(spark, path).current()
    told = read_versions(spark, path).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("points"))
    return told.select(F.lit(now["version"]).cast("bigint").alias("batches"), F.lit(now["base"] is not None).alias("merged"), "pairs", "points")


@query(f"SELECT CAST(user_id AS VARCHAR) AS cell_id, event_type AS gene, count(*) AS n FROM events WHERE {_EVENTS_VALID} AND user_id > 0 GROUP BY ALL")
def stream_cell_gene_merge(spark, sf):
    """The same totals with no state kept between batches."""
    path = scratch(spark, "cell-merge")
    st.merge_cell_gene_counts(_canonical(spark, sf), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return st.merged_totals(spark, f"{path}/table")


@query(f"""
    SELECT event_type AS gene, user_id AS assignment, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y, NOT (coalesce(user_id, 0) > 0) AS background
    FROM events WHERE {_EVENTS_VALID}""")
def stream_ingest(spark, sf):
    path = scratch(spark, "ingest")
    st.stream_ingest(_arriving(spark, sf), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("gene", "assignment", "x", "y", "background")
