"""Checks and exports of tissue and object annotations, over many sections at once.

``annotations(section, role, tissue_piece_id, shape_ord, vertices)`` has one row per drawn shape, with
``vertices`` in geometry order (x, y) and ``shape_ord`` counted from 0 inside its layer. Findings are
rows ``(section, piece, role, shape_ord, severity, rule, message)``, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.functions.text import piece_id_or_default, safe_identifier, strip
from cytoplane.operators.grid import meeting_boxes, place_boxes, place_points
from cytoplane.operators.ordering import running_in_group
from cytoplane.session import materialize

# Roles with their name in GeoJSON, their layer name, and the stem of their own file.
ROLE_NAMES = {
    "pia": "pial_boundary",
    "wm": "gray_white_boundary",
    "side": "side_boundary",
    "exclusion": "exclusion",
    "ribbon": "cortical_ribbon",
}
LAYER_NAMES = {
    "pia": "Pial boundary",
    "wm": "Gray/white boundary",
    "side": "Tissue edge boundary",
    "exclusion": "Exclusion polygons",
    "ribbon": "Cortical ribbon",
}
FILE_STEMS = {
    "pia": "pial_boundary",
    "wm": "wm_boundary",
    "side": "side_boundaries",
    "exclusion": "exclusion_masks",
    "ribbon": "cortical_ribbon",
}
LINE_ROLES = ("pia", "wm", "side")
POLYGON_ROLES = ("exclusion", "ribbon")
PIECE_ROLES = ("pia", "wm", "exclusion", "ribbon")
DEPTH_MODE = "depth"
MASK_MODE = "mask_qc_only"

#: What a finding says after the shape, piece or set it is about. The rule is the contract; these are for people.
TEXTS = {
    "non_finite": " has a coordinate that is not a finite number.",
    "line_points": " needs two different points at least.",
    "closed_line": " ends where it begins, but a pia or wm line must be open.",
    "polygon_points": " needs three different points at least.",
    "zero_area": " encloses nothing.",
    "self_intersecting": " touches or crosses itself.",
    "merged_segments": " segments were joined into one line.",
    "unmergeable_segments": " is in segments that do not form one line.",
    "snap_missing": "There is no tissue edge to snap to.",
    "snap_several": "There are several tissue edges; snapping needs one.",
    "missing_edge": "There is no tissue edge.",
    "multiple_edges": "There are several tissue edges; one is allowed.",
    "no_pieces": "There is no piece, so there is no pia.",
    "wm_without_pia": " has a wm line without a pia line.",
    "polygons_without_pia": " has polygons without a pia line.",
    "boundaries_cross": ": the pia and wm lines meet.",
    "exclusion_touches": " meets the pia or wm line, which takes boundary pixels away from a depth solve.",
    "endpoint_gap": " does not lie on the tissue edge; it is this far off: ",
    "pial_only_ribbon": ": a pia without a wm must cut exactly one polygon from the edge, or the ribbon be drawn.",
    "no_ribbon": ": edge, pia and wm bound no polygon; snap the ends to the edge or draw the ribbon.",
    "several_ribbons": ": edge, pia and wm bound several polygons; the smallest is taken unless the ribbon is drawn.",
    "pieces_overlap": " have ribbons that overlap.",
    "blank_name": "An object set has no name.",
    "empty_set": " is a set without a polygon.",
    "duplicate_id": " is the id of more than one object.",
    "no_objects": "There is no object polygon.",
}

#: Vertices up to which the sides of a ring are compared all with all.
SHORT_RING = 24

SHAPE = ["section", "role", "piece", "shape_ord"]
FINDING = ["section", "piece", "role", "shape_ord", "severity", "rule", "message"]


def canonical(annotations: DataFrame) -> DataFrame:
    """Piece ids trimmed with their default filled in, and repeated vertices removed."""
    return annotations.select(
        "section",
        "role",
        F.when(F.col("role") == "side", F.lit(None).cast("string")).otherwise(
            piece_id_or_default("tissue_piece_id")
        ).alias("piece"),
        F.col("shape_ord").cast("bigint").alias("shape_ord"),
        F.expr(g.drop_repeats("vertices")).alias("vertices"),
    )


def drop_repeat_vertices(annotations: DataFrame) -> DataFrame:
    """Remove vertices that repeat the one before them."""
    return annotations.withColumn("vertices", F.expr(g.drop_repeats("vertices")))


def relabel_pieces(annotations: DataFrame, updates: DataFrame) -> DataFrame:
    """Give the selected shapes of the piece roles a new piece id."""
    new = updates.select(
        F.col("section").alias("_section"), F.col("role").alias("_role"), F.col("shape_ord").alias("_shape_ord"),
        F.col("tissue_piece_id").alias("_piece"), piece_id_or_default("new_piece_id").alias("_new"),
    )
    same = (
        (F.col("section") == F.col("_section")) & (F.col("role") == F.col("_role"))
        & (F.col("shape_ord") == F.col("_shape_ord")) & F.col("tissue_piece_id").eqNullSafe(F.col("_piece"))
    )
    piece = F.when(F.col("role") == "side", F.col("tissue_piece_id")).otherwise(F.coalesce("_new", "tissue_piece_id"))
    return annotations.join(new, same, "left").withColumn("tissue_piece_id", piece).select(*annotations.columns)


def _finding(df: DataFrame, severity: str, rule, message: Column) -> DataFrame:
    have = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("section", "piece", "role", "shape_ord")}
    return df.select(
        have["section"].cast("string").alias("section"),
        have["piece"].cast("string").alias("piece"),
        have["role"].cast("string").alias("role"),
        have["shape_ord"].cast("bigint").alias("shape_ord"),
        F.lit(severity).alias("severity"),
        (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"),
        message.alias("message"),
    )


def _text(names: dict[str, str]) -> Column:
    """The text for the rule in ``_rule``, by rule."""
    return F.create_map(*[F.lit(v) for rule, name in names.items() for v in (rule, TEXTS[name])])[F.col("_rule")]


def _shape_label() -> Column:
    names = F.create_map(*[F.lit(v) for pair in LAYER_NAMES.items() for v in pair])
    return F.concat(names[F.col("role")], F.lit(" shape "), (F.col("shape_ord") + 1).cast("string"))


def check_lines(shapes: DataFrame) -> DataFrame:
    """Errors of line shapes. At most one per shape: the first rule it breaks."""
    lines = shapes.filter(F.col("role").isin(*LINE_ROLES))
    v = F.col("vertices")
    rule = (
        F.when(~F.expr(g.all_finite("vertices")), F.lit("non_finite"))
        .when(F.size(v) < 2, F.lit("too_few_points"))
        .when(
            (F.col("role") != "side") & F.expr(g.all_close(g.first_of("vertices"), g.last_of("vertices"))),
            F.lit("closed_line"),
        )
    )
    text = _text({"non_finite": "non_finite", "too_few_points": "line_points", "closed_line": "closed_line"})
    broken = lines.withColumn("_rule", rule).filter(F.col("_rule").isNotNull())
    return _finding(broken, "error", F.col("_rule"), F.concat(_shape_label(), text))


def _edge_rows(shapes: DataFrame, keys: list[str], ring: bool) -> DataFrame:
    """One row per edge with its box; ``ring`` says whether a shape is closed up."""
    edges = F.expr(g.edges_of_ring("vertices") if ring else g.edges_of_line("vertices"))
    rows = shapes.withColumn("_edges", edges).select(
        *keys, F.size("_edges").alias("n"), F.posexplode("_edges").alias("i", "e")
    )
    return rows.withColumns({
        "xmin": F.least("e.x1", "e.x2"),
        "ymin": F.least("e.y1", "e.y2"),
        "xmax": F.greatest("e.x1", "e.x2"),
        "ymax": F.greatest("e.y1", "e.y2"),
    })


def _self_touching(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Shapes whose ring touches itself: edges of a short ring all with all in their row, others on the grid."""
    short = F.size("vertices") <= SHORT_RING
    next_to = "sj - si = 1 OR (si = 0 AND sj = size(se) - 1)"
    wrong = f"sj > si AND CASE WHEN {next_to} THEN {g.folds_back('sa', 'sb')} ELSE {g.segments_touch('sa', 'sb')} END"
    bent = F.expr(g.let(g.edges_of_ring("vertices"), "se", f"size(filter(se, (sa, si) -> size(filter(se, (sb, sj) -> {wrong})) > 0)) > 0"))
    plain = shapes.filter(short).filter(bent).select(*keys)
    edges = _edge_rows(shapes.filter(~short), keys, ring=True)
    next_to = (F.col("r_i") - F.col("l_i") == 1) | ((F.col("l_i") == 0) & (F.col("r_i") == F.col("l_n") - 1))
    # Neighbours always share a corner; they are wrong only when one folds back along the other.
    touch, folds = F.expr(g.segments_touch("l_e", "r_e")), F.expr(g.folds_back("l_e", "r_e"))
    condition = (F.col("l_i") < F.col("r_i")) & F.when(next_to, folds).otherwise(touch)
    return plain.unionByName(meeting_boxes(edges, edges, keys, condition).select(*keys)).distinct()


def check_polygons(shapes: DataFrame, keys: list[str] | None = None, label: Column | None = None) -> DataFrame:
    """Errors of polygon shapes: finite, three points, an area, no self-intersection."""
    keys = keys or SHAPE
    polygons = shapes.filter(F.col("role").isin(*POLYGON_ROLES)) if keys == SHAPE else shapes
    first = (
        F.when(~F.expr(g.all_finite("vertices")), F.lit("non_finite"))
        .when(F.size("vertices") < 3, F.lit("too_few_points"))
        .when(F.expr(g.ring_area("vertices")) <= 0, F.lit("zero_area"))
    )
    judged = polygons.withColumn("_rule", first)
    plain = judged.filter(F.col("_rule").isNotNull())
    bent = _self_touching(judged.filter(F.col("_rule").isNull()), keys).withColumn("_rule", F.lit("self_intersecting"))
    named = plain.select(*keys, "_rule").unionByName(bent.select(*keys, "_rule"))
    same = {k: k for k in ("non_finite", "zero_area", "self_intersecting")}
    text = _text(same | {"too_few_points": "polygon_points"})
    return _finding(named, "error", F.col("_rule"), F.concat(_shape_label() if label is None else label, text))


def usable_shapes(shapes: DataFrame, errors: DataFrame) -> DataFrame:
    """Shapes without an error of their own."""
    bad = errors.select(*[F.col(k).alias(f"_{k}") for k in SHAPE])
    # Pieces are null for edges, so the key is compared as text with a blank for null.
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")) == F.coalesce(F.col(f"_{k}").cast("string"), F.lit("")) for k in SHAPE]
    return shapes.join(bad, same, "left_anti")


# ---------------------------------------------------------------------------------------------
# Lines of a piece
# ---------------------------------------------------------------------------------------------

def _ranked(lines: DataFrame, key: list[str], longest: int) -> DataFrame:
    """Segments of paths in order: (*key, parts, place, vertices as walked); pieces of several paths are left out.

    Each segment can be walked either way, and each way knows the one that goes on at its last vertex, if any. By pointer
    doubling every way learns how many follow it and which is the last: each round joins a way with the one it points at,
    and so doubles its reach. ``longest`` is the largest number of segments of a piece.
    """
    segments = materialize(lines.withColumn("_id", F.monotonically_increasing_id()))
    ends = segments.select(*key, "_id", F.posexplode(F.array(F.element_at("vertices", 1), F.element_at("vertices", -1))).alias("_side", "_v"))
    met = ends.groupBy(*key, "_v").agg(F.collect_list(F.struct("_id", "_side")).alias("_e"))  # at most two
    # A way is twice the segment's number, plus one if it is walked from its last vertex to its first.
    links = met.filter(F.size("_e") == 2).select(*key, F.explode(F.array(
        F.struct(F.col("_e")[0].alias("a"), F.col("_e")[1].alias("b")), F.struct(F.col("_e")[1].alias("a"), F.col("_e")[0].alias("b")))).alias("_l"))
    links = links.select((F.col("_l.a._id") * 2 + 1 - F.col("_l.a._side")).alias("way"), (F.col("_l.b._id") * 2 + F.col("_l.b._side")).alias("next"))
    # A path starts at the loose end of its first segment that has one; a ring at the first vertex of its first segment.
    loose = met.filter(F.size("_e") == 1).select(*key, F.col("_e")[0]["_id"].alias("_id"), F.col("_e")[0]["_side"].alias("_side"))
    first = segments.join(loose, [*key, "_id"], "left").groupBy(*key).agg(
        F.min(F.struct(F.col("_side").isNull().alias("_no"), "shape_ord", "_id", "_side")).alias("_f"), F.countDistinct("_id").alias("parts"))
    first = first.select(*key, "parts", (F.col("_f._id") * 2 + F.coalesce("_f._side", F.lit(0))).alias("_start"))
    ways = segments.select(*key, F.explode(F.array(F.col("_id") * 2, F.col("_id") * 2 + 1)).alias("way")).join(links, "way", "left")
    # Nothing goes on to the start, so that a ring ends before it.
    cut = ways.join(first, key).withColumn("next", F.when(F.col("next") != F.col("_start"), F.col("next")))
    ranks = materialize(cut.select("way", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("left"), F.coalesce("next", "way").alias("last")))
    for _ in range(max(longest - 1, 1).bit_length()):
        ahead = ranks.select(F.col("way").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"), F.col("last").alias("_last"))
        ranks = materialize(ranks.join(ahead, "next", "left").select(
            "way", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"), F.coalesce("_last", "last").alias("last")))
    ended = ranks.filter(F.col("next").isNull()).select("way", "left", "last")
    whole = first.join(ended.select(F.col("way").alias("_start"), F.col("left").alias("_all"), F.col("last").alias("_last")), "_start")
    whole = whole.filter(F.col("_all") == F.col("parts") - 1)
    walked = segments.join(whole, key).join(
        ended.select(F.floor(F.col("way") / 2).alias("_id"), (F.col("way") % 2 == 1).alias("_turned"), "left", F.col("last").alias("_last")), ["_id", "_last"])
    vertices = F.when(F.col("_turned"), F.reverse("vertices")).otherwise(F.col("vertices"))
    return walked.select(*key, "parts", (F.col("_all") - F.col("left")).alias("place"), vertices.alias("vertices"))


def merge_piece_lines(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One line per (section, piece, role) and the findings about it.

    Single segments pass through. Several segments are chained only where their end points can form
    one path (all shared by two segments, but for two loose ends or none) and do form one: their order comes from
    list ranking in a number of joins that grows with the logarithm of the largest piece.
    """
    key = ["section", "role", "piece"]
    lines = shapes.filter(F.col("role").isin("pia", "wm"))
    counts = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("parts"))
    single = lines.join(counts.filter("parts = 1"), key).select(*key, "parts", "vertices")
    ends = lines.select(*key, F.explode(F.array(F.element_at("vertices", 1), F.element_at("vertices", -1))).alias("v"))
    degree = ends.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("d"))
    chains = degree.groupBy(*key).agg(F.max("d").alias("top"), F.count_if(F.col("d") == 1).alias("loose"))
    ready = chains.filter((F.col("top") == 2) & F.col("loose").isin(0, 2)).select(*key)
    several = counts.filter("parts > 1")
    candidates = several.join(ready, key, "left_semi")
    longest = candidates.agg(F.max("parts")).first()[0] or 1
    ordered = None
    if longest > 1:
        ordered = _ranked(lines.join(candidates.select(*key), key, "left_semi").select(*key, "shape_ord", "vertices"), key, longest)
    walk = F.array_sort(F.collect_list(F.struct("place", "vertices")))
    chained = single.limit(0) if ordered is None else materialize(ordered.groupBy(*key, "parts").agg(walk.alias("_walk")).select(*key, "parts", F.expr(
        "flatten(transform(_walk, (w, i) -> CASE WHEN i = 0 THEN w.vertices ELSE slice(w.vertices, 2, greatest(size(w.vertices) - 1, 0)) END))"
    ).alias("vertices")))
    merged = single.unionByName(chained.select(*single.columns))
    what = F.concat("piece", F.lit(" "), "role")
    warned = _finding(chained, "warning", "merged_segments", F.concat(
        what, F.lit(": "), F.col("parts").cast("string"), F.lit(TEXTS["merged_segments"])
    ))
    failed = _finding(several.join(chained.select(*key), key, "left_anti"), "error", "unmergeable_segments", F.concat(
        what, F.lit(TEXTS["unmergeable_segments"])
    ))
    return merged, warned.unionByName(failed)


def single_edges(shapes: DataFrame) -> DataFrame:
    """The edge line of each section that has exactly one."""
    sides = shapes.filter(F.col("role") == "side")
    return sides.groupBy("section").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("vertices", "shape_ord").alias("edge")
    ).filter("_n = 1").select("section", "edge")


def _edge_count_findings(shapes: DataFrame, none: str, many: str) -> DataFrame:
    per = shapes.groupBy("section").agg(F.count_if(F.col("role") == "side").alias("_n")).filter("_n <> 1")
    rule = F.when(F.col("_n") == 0, F.lit("missing_edge")).otherwise(F.lit("multiple_edges"))
    return _finding(per, "error", rule, F.when(F.col("_n") == 0, F.lit(none)).otherwise(F.lit(many)))


def snap_to_edge(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pia and wm lines with both end points moved to the nearest point of the section's edge."""
    errors = _edge_count_findings(
        shapes,
        TEXTS["snap_missing"],
        TEXTS["snap_several"],
    )
    lines = shapes.filter(F.col("role").isin("pia", "wm")).join(single_edges(shapes), "section")
    ends = lines.withColumns({"_p": F.expr(g.first_of("vertices")), "_q": F.expr(g.last_of("vertices"))})
    moved = ends.withColumns({
        "_p": F.expr(g.nearest_on_line("edge", "_p.x", "_p.y")), "_q": F.expr(g.nearest_on_line("edge", "_q.x", "_q.y"))
    })
    snapped = F.expr(
        "transform(vertices, (v, i) -> CASE WHEN i = 0 THEN named_struct('x', _p.x, 'y', _p.y) "
        "WHEN i = size(vertices) - 1 THEN named_struct('x', _q.x, 'y', _q.y) ELSE v END)"
    )
    return moved.withColumn("vertices", snapped).drop("edge", "_p", "_q"), errors


def piece_mode(shapes: DataFrame) -> DataFrame:
    """Mode of each piece that has a pia: depth with a wm, else mask and QC only."""
    per = shapes.filter(F.col("role").isin(*PIECE_ROLES)).groupBy("section", "piece").agg(
        F.max(F.col("role") == "pia").alias("_pia"), F.max(F.col("role") == "wm").alias("_wm")
    )
    mode = F.when(F.col("_wm"), F.lit(DEPTH_MODE)).otherwise(F.lit(MASK_MODE))
    return per.filter("_pia").select("section", "piece", mode.alias("piece_mode"))


def piece_ids(shapes: DataFrame) -> DataFrame:
    """Union of the piece ids of the four piece roles."""
    ids = [shapes.filter(F.col("role") == role).select("section", "piece") for role in PIECE_ROLES]
    out = ids[0]
    for one in ids[1:]:
        out = out.union(one)
    return out.distinct()


def piece_rule_errors(shapes: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Errors about what a section or piece must have.

    ``shapes`` are those before their lines are merged. ``sections`` names all that were drawn in, also those
    without a usable shape; by default the sections of ``shapes``.
    """
    if sections is not None:
        blank = sections.select("section").distinct()
        shapes = shapes.unionByName(blank, allowMissingColumns=True)
    edges = _edge_count_findings(shapes, TEXTS["missing_edge"], TEXTS["multiple_edges"])
    bare = shapes.groupBy("section").agg(F.count_if(F.col("role").isin(*PIECE_ROLES)).alias("_n")).filter("_n = 0")
    empty = _finding(bare, "error", "no_pieces", F.lit(TEXTS["no_pieces"]))
    per = shapes.filter(F.col("role").isin(*PIECE_ROLES)).groupBy("section", "piece").agg(
        F.max(F.col("role") == "pia").alias("_pia"), F.max(F.col("role") == "wm").alias("_wm")
    ).filter("NOT _pia")
    judged = per.withColumn("_rule", F.when(F.col("_wm"), F.lit("wm_without_pia")).otherwise(F.lit("polygons_without_pia")))
    text = _text({k: k for k in ("wm_without_pia", "polygons_without_pia")})
    return edges.unionByName(empty).unionByName(_finding(judged, "error", F.col("_rule"), F.concat("piece", text)))


# ---------------------------------------------------------------------------------------------
# Relations between shapes
# ---------------------------------------------------------------------------------------------

def boundary_crossings(shapes: DataFrame) -> DataFrame:
    """Pieces whose pia and wm share a point."""
    key = ["section", "piece"]
    pia = _edge_rows(shapes.filter(F.col("role") == "pia"), key, ring=False)
    wm = _edge_rows(shapes.filter(F.col("role") == "wm"), key, ring=False)
    met = meeting_boxes(pia, wm, key, F.expr(g.segments_touch("l_e", "r_e"))).select(*key).distinct()
    return _finding(met, "warning", "boundaries_cross", F.concat("piece", F.lit(TEXTS["boundaries_cross"])))


def exclusion_contacts(shapes: DataFrame) -> DataFrame:
    """Exclusion polygons that touch or overlap the pia or wm of their piece."""
    key = ["section", "piece"]
    has_pia = shapes.filter(F.col("role") == "pia").select(*key).distinct()
    lines = shapes.filter(F.col("role").isin("pia", "wm")).join(has_pia, key, "left_semi")
    polygons = shapes.filter(F.col("role") == "exclusion")
    touched = meeting_boxes(
        _edge_rows(polygons, [*key, "shape_ord"], ring=True),
        _edge_rows(lines, key, ring=False),
        key,
        F.expr(g.segments_touch("l_e", "r_e")),
    ).select(*key, F.col("l_shape_ord").alias("shape_ord"))
    # A line that meets no side of a polygon is inside it when its first vertex is.
    starts = lines.select(*key, F.element_at("vertices", 1).alias("_v")).select(*key, F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))
    boxes = polygons.select(
        *key,
        "shape_ord",
        F.expr(g.edges_of_ring("vertices")).alias("_edges"),
        *[c.alias(name) for name, c in g.bounds("vertices").items()],
    )
    inside = place_points(starts, boxes).join(place_boxes(boxes), [*key, "_level", "_gx", "_gy"]).filter(
        F.expr(g.covers("_edges", "x", "y"))
    ).select(*key, "shape_ord")
    # People count the exclusions of a piece, not those of the layer.
    place = F.row_number().over(Window.partitionBy(*key).orderBy("shape_ord"))
    numbered = polygons.select(*key, "shape_ord", place.alias("_place"))
    met = touched.unionByName(inside).distinct().join(numbered, [*key, "shape_ord"]).withColumn("role", F.lit("exclusion"))
    return _finding(met, "warning", "exclusion_touches", F.concat(
        F.col("piece"), F.lit(": exclusion "), F.col("_place").cast("string"), F.lit(TEXTS["exclusion_touches"])
    ))


def _three_digits(value: Column) -> Column:
    """Text of a positive number with three significant digits, with an exponent below 1e-4 and from 1000 up."""
    power = F.floor(F.log10(value))
    digits = F.round(value / F.pow(F.lit(10.0), power) * 100).cast("bigint")
    # 9.996 rounds to 10.0, which is one power more.
    power, digits = F.when(digits >= 1000, power + 1).otherwise(power), F.when(digits >= 1000, F.lit(100)).otherwise(digits).cast("string")

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    at = (power + 1).cast("int")
    plain = F.when(power >= 0, F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.lit(3)))).otherwise(
        F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits)
    )
    mantissa = trimmed(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2)))
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    long = F.concat(mantissa, sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when((power < -4) | (power >= 3), long).otherwise(trimmed(plain))


def endpoint_gaps(shapes: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """End points of pia and wm that lie too far from the edge.

    The tolerance is 2 % of the piece's longer line. Pieces with an explicit ribbon, without a pia, or
    in a section without a single edge are not judged.
    """
    key = ["section", "piece"]
    lines = (shapes if merged is None else merged).filter(F.col("role").isin("pia", "wm")).select(*key, "role", "vertices")
    sized = lines.withColumn("_len", F.expr(g.line_length("vertices")))
    limit = sized.groupBy(*key).agg(F.max("_len").alias("_max"), F.max(F.col("role") == "pia").alias("_pia"))
    limit = limit.filter("_pia").select(*key, F.greatest(F.lit(1e-6), F.col("_max") * 0.02).alias("tolerance"))
    ribbons = shapes.filter(F.col("role") == "ribbon").select(*key)
    ends = F.array(
        F.struct(F.lit("start").alias("end"), F.element_at("vertices", 1).alias("v")),
        F.struct(F.lit("end").alias("end"), F.element_at("vertices", -1).alias("v")),
    )
    points = lines.join(ribbons, key, "left_anti").select(*key, "role", F.explode(ends).alias("_e"))
    far = (
        points.join(single_edges(shapes), "section")
        .withColumn("distance", F.sqrt(F.expr(g.nearest_on_line("edge", "_e.v.x", "_e.v.y") + ".d2")))
        .join(limit, key)
        .filter("distance > tolerance")
        .select(*key, "role", F.col("_e.end").alias("end"), "distance", "tolerance")
    )
    return far


def endpoint_gap_findings(gaps: DataFrame) -> DataFrame:
    return _finding(gaps, "warning", "endpoint_gap", F.concat(
        F.col("piece"), F.lit(": the "), F.col("end"), F.lit(" of the "), F.col("role"), F.lit(TEXTS["endpoint_gap"]),
        _three_digits(F.col("distance")),
    ))


# -- Ribbons from the edge ----------------------------------------------------------------------

def _measured_edges(shapes: DataFrame) -> DataFrame:
    """The edge of each section with the running length at every vertex, as ``_v``."""
    edges = single_edges(shapes)
    each = edges.select("section", F.posexplode("edge").alias("i", "v"))
    along = Window.partitionBy("section").orderBy("i")
    step = F.hypot(F.col("v.x") - F.lag("v.x").over(along), F.col("v.y") - F.lag("v.y").over(along))
    run = F.sum(F.coalesce("_step", F.lit(0.0))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = each.withColumn("_step", step).withColumn("s", run)
    vertices = placed.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("i", "v.x", "v.y", "s"))).alias("_v"))
    return edges.join(vertices, "section")


def _on_edge(point: str) -> Column:
    """Where a point falls on the edge: ``struct<x,y,s>``."""
    length = "get(_v, pl.i).s + hypot(pl.x - get(_v, pl.i).x, pl.y - get(_v, pl.i).y)"
    found = g.nearest_on_line("edge", f"{point}.x", f"{point}.y")
    # A point that lies on the edge keeps its own coordinates, or rounding would fold the ring there.
    own = {c: f"CASE WHEN pl.d2 <= 1e-18D THEN {point}.{c} ELSE pl.{c} END" for c in "xy"}
    return F.expr(g.let(found, "pl", f"named_struct('x', {own['x']}, 'y', {own['y']}, 's', {length})"))


def _walk(start: str, end: str, way: str) -> str:
    """Vertices along the edge from one place to another: way 0 between them, way 1 over the seam of a closed edge."""
    between = f"filter(_v, q -> q.s > least({start}.s, {end}.s) + 1e-9D AND q.s < greatest({start}.s, {end}.s) - 1e-9D)"
    before, after = (lambda p: f"filter(_v, q -> q.s < {p}.s - 1e-9D)"), (lambda p: f"filter(_v, q -> q.s > {p}.s + 1e-9D)")
    rising = f"{start}.s <= {end}.s"
    inner = (
        f"CASE WHEN {way} = 0 AND {rising} THEN {between} WHEN {way} = 0 THEN reverse({between}) "
        f"WHEN {rising} THEN concat(reverse({before(start)}), reverse({after(end)})) "
        f"ELSE concat({after(start)}, {before(end)}) END"
    )
    ends = [f"array(named_struct('x', {p}.x, 'y', {p}.y))" for p in (start, end)]
    return f"concat({ends[0]}, transform({inner}, q -> named_struct('x', q.x, 'y', q.y)), {ends[1]})"


def _with_ends(line: str, first: str, last: str) -> str:
    """A line whose ends are moved to their places on the edge where these are within ``_tolerance``."""
    def moved(v: str, p: str) -> str:
        return f"CASE WHEN hypot({v}.x - {p}.x, {v}.y - {p}.y) <= _tolerance THEN named_struct('x', {p}.x, 'y', {p}.y) ELSE {v} END"

    return f"transform({line}, (v, i) -> CASE WHEN i = 0 THEN {moved('v', first)} WHEN i = size({line}) - 1 THEN {moved('v', last)} ELSE v END)"


def _ribbon_rings(pieces: DataFrame, measured: DataFrame) -> DataFrame:
    """Candidate rings as rows (section, piece, candidate, vertices, area, cx, cy).

    The ring leaves the pia at its last vertex, walks the edge to one end of the wm, follows the wm, and walks the edge
    back to the pia's first vertex; without a wm it walks back at once. Either end of the wm may come first, and on a
    closed edge each walk may take either way. What is stored of a piece are places on its edge; the edge itself is kept
    once a section and looked at again when the walks are cut from it.
    """
    ready = pieces.join(measured, "section")
    closed = F.expr("size(edge) > 2 AND hypot(edge[0].x - get(edge, size(edge) - 1).x, edge[0].y - get(edge, size(edge) - 1).y) <= 1e-9D")
    ways = F.when(closed, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    has_wm = F.col("wm").isNotNull()
    turned = ready.withColumn("_turn", F.explode(F.when(has_wm, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    turned = turned.withColumn("_line", F.when(F.col("_turn"), F.col("wm")).otherwise(F.reverse("wm")))
    turned = turned.withColumns({
        "_start": _on_edge("pia[0]"), "_end": _on_edge("get(pia, size(pia) - 1)"),
        "_near": F.when(has_wm, _on_edge("_line[0]")), "_far": F.when(has_wm, _on_edge("get(_line, size(_line) - 1)")),
    })
    # Stored, as each place along the edge is named many times below.
    # Ends within the tolerance of an end-point gap count as being on the edge.
    size = F.greatest(F.expr(g.line_length("pia")), F.coalesce(F.expr(g.line_length("wm")), F.lit(0.0)))
    turned = turned.withColumn("_tolerance", F.greatest(F.lit(1e-6), size * 0.02))
    placed = materialize(turned.select(
        "section", "piece", "wm", "_turn", "_start", "_end", "_near", "_far", ways.alias("_ways"),
        F.expr(_with_ends("pia", "_start", "_end")).alias("pia"), F.expr(_with_ends("_line", "_near", "_far")).alias("_line"),
    ))
    both = placed.withColumn("_out", F.explode("_ways")).withColumn(
        "_back", F.explode(F.when(has_wm, F.col("_ways")).otherwise(F.array(F.lit(0))))
    )
    apart = lambda a, b: F.abs(F.col(f"{a}.s") - F.col(f"{b}.s")) > 1e-9
    first = F.when(has_wm, apart("_end", "_near")).otherwise(apart("_end", "_start"))
    both = both.filter(((F.col("_out") == 0) | first) & ((F.col("_back") == 0) | apart("_far", "_start")))
    both = both.join(measured.select("section", "_v"), "section")
    ring = F.when(has_wm, F.expr(f"concat(pia, {_walk('_end', '_near', '_out')}, _line, {_walk('_far', '_start', '_back')})")).otherwise(
        F.expr(f"concat(pia, {_walk('_end', '_start', '_out')})")
    )
    rings = both.select("section", "piece", F.concat_ws("/", "_turn", "_out", "_back").alias("candidate"), ring.alias("vertices"))
    rings = materialize(rings.withColumn("vertices", F.expr(g.drop_repeats("vertices"))))
    last = "get(vertices, size(vertices) - 1)"
    opened = F.expr(
        f"CASE WHEN size(vertices) > 1 AND hypot(vertices[0].x - {last}.x, vertices[0].y - {last}.y) <= 1e-9D "
        "THEN slice(vertices, 1, size(vertices) - 1) ELSE vertices END"
    )
    rings = rings.withColumn("vertices", opened).filter(F.size("vertices") >= 3)
    measures = F.expr(g.polygon_measures(f"array(named_struct('exterior', vertices, 'holes', {g.NO_HOLES}))"))
    return rings.withColumn("_m", measures).select("section", "piece", "candidate", "vertices", "_m.*").filter("area > 0")


def ribbon_from_edge(merged: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ribbon of each piece: pia, a stretch of edge and, with a wm, the wm and a second stretch.

    Pieces with an explicit ribbon are not built here. Only simple rings count as candidates, rings with the same area
    and centroid as one; the smallest is taken. Returns (ribbons, findings).
    """
    key = ["section", "piece"]
    explicit = shapes.filter(F.col("role") == "ribbon").select(*key)
    pia = merged.filter(F.col("role") == "pia").select(*key, F.col("vertices").alias("pia"))
    wm = merged.filter(F.col("role") == "wm").select(*key, F.col("vertices").alias("wm"))
    measured = materialize(_measured_edges(shapes))
    ready = materialize(pia.join(explicit, key, "left_anti").join(wm, key, "left").join(measured.select("section"), "section"))
    rings = materialize(_ribbon_rings(ready, measured))
    simple = rings.join(_self_touching(rings, [*key, "candidate"]), [*key, "candidate"], "left_anti")
    same = [F.round(c, 6).alias(f"_{c}") for c in ("area", "cx", "cy")]
    once = simple.groupBy(*key, *same).agg(F.min(F.struct("area", "candidate", "vertices")).alias("_r"))
    best = once.groupBy(*key).agg(F.count(F.lit(1)).alias("candidates"), F.min("_r").alias("_r"))
    built = ready.select(*key, F.col("wm").isNotNull().alias("_wm")).join(best, key, "left").select(
        *key, "_wm", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.col("_r.area").alias("area"),
        F.expr(g.close_ring("_r.vertices")).alias("ring"),
    )
    judged = materialize(built.withColumn("_rule", (
        F.when(~F.col("_wm") & (F.col("candidates") != 1), F.lit("pial_only_ribbon"))
        .when(F.col("_wm") & (F.col("candidates") == 0), F.lit("no_ribbon"))
        .when(F.col("_wm") & (F.col("candidates") > 1), F.lit("several_ribbons"))
    )))
    told = judged.filter(F.col("_rule").isNotNull())
    message = F.concat(F.col("piece"), _text({k: k for k in ("pial_only_ribbon", "no_ribbon", "several_ribbons")}))
    errors = _finding(told.filter("_rule <> 'several_ribbons'"), "error", F.col("_rule"), message)
    warnings = _finding(told.filter("_rule = 'several_ribbons'"), "warning", F.col("_rule"), message)
    usable = judged.filter(F.coalesce(F.col("_rule") == "several_ribbons", F.lit(True)))
    return usable.select(*key, "candidates", "area", "ring"), errors.unionByName(warnings)


def piece_overlaps(polygons: DataFrame) -> DataFrame:
    """Pairs of pieces of a section whose polygons share an area.

    ``polygons(section, piece, vertices)``; a piece may have several. Polygons meet by their boxes on
    the grid; then sides must cross, or one polygon must hold a corner, a side's middle or an inner point of the other.
    Equal polygons of a section are judged once, each of them also against itself; their pieces come by joins on its number.
    """
    drawn = polygons.select("section", "piece", "vertices").filter(F.col("section").isNotNull() & F.col("piece").isNotNull())
    members = drawn.distinct().withColumn("_lone", F.count(F.lit(1)).over(Window.partitionBy("section", "piece")) == 1)
    shapes = materialize(members.select("section", "vertices").distinct().withColumn("_shape", F.monotonically_increasing_id()))
    members = materialize(members.join(shapes, ["section", "vertices"]).select("_shape", "piece", "_lone"))
    boxes = shapes.select(
        "section",
        "_shape",
        F.expr(g.edges_of_ring("vertices")).alias("edges"),
        *[c.alias(name) for name, c in g.bounds("vertices").items()],
    ).withColumn("m", F.expr(g.inner_point("edges")))

    def held(mine: str, other: str) -> str:
        corner = g.contains_strictly(other, "h.x1", "h.y1")
        middle = g.contains_strictly(other, "((h.x1 + h.x2) / 2)", "((h.y1 + h.y2) / 2)")
        return f"exists({mine}, h -> {corner} OR {middle})"

    def centred(m: str) -> str:
        return " AND ".join(g.contains_strictly(edges, f"{m}.x", f"{m}.y") for edges in ("l_edges", "r_edges"))

    crossing = f"exists(l_edges, u -> exists(r_edges, w -> {g.segments_cross('u', 'w')}))"
    tests = [crossing, held("l_edges", "r_edges"), held("r_edges", "l_edges"), centred("l_m"), centred("r_m")]
    condition = F.expr("l__shape <= r__shape AND (" + " OR ".join(f"({t})" for t in tests) + ")")
    met = materialize(meeting_boxes(boxes, boxes, ["section"], condition).select("section", "l__shape", "r__shape"))
    one, other = (
        members.select(F.col("_shape").alias(f"{side}__shape"), F.col("piece").alias(f"_{side}"), F.col("_lone").alias(f"_{side}_lone")) for side in "lr"
    )
    found = met.join(one, "l__shape").join(other, "r__shape")
    # Within one polygon each pair of pieces is met both ways.
    found = found.filter(F.when(F.col("l__shape") == F.col("r__shape"), F.col("_l") < F.col("_r")).otherwise(F.col("_l") != F.col("_r")))
    pairs = found.select("section", F.least("_l", "_r").alias("left_piece"), F.greatest("_l", "_r").alias("right_piece"), (F.col("_l_lone") & F.col("_r_lone")).alias("_once"))
    # Only pieces of several polygons can meet more than once.
    return pairs.filter("_once").drop("_once").unionByName(pairs.filter("NOT _once").drop("_once").distinct())


def piece_overlap_findings(pairs: DataFrame) -> DataFrame:
    return _finding(pairs, "warning", "pieces_overlap", F.concat(
        "left_piece", F.lit(" and "), "right_piece", F.lit(TEXTS["pieces_overlap"])
    ))


# ---------------------------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------------------------

def _line_json(vertices: str) -> Column:
    return F.expr(f"to_json(transform({vertices}, jv -> array(jv.x, jv.y)))")


def _polygon_json(vertices: str) -> Column:
    return F.concat(F.lit("["), _line_json(g.close_ring(vertices)), F.lit("]"))


def _geometry(kind: Column | str, coordinates: Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coordinates, F.lit("}"))


def _feature(properties: Column, geometry: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))


def annotation_features(shapes: DataFrame, merged: DataFrame, dataset: str | None = None) -> DataFrame:
    """GeoJSON features in export order: edge, then per piece pia, wm, exclusions, ribbons.

    ``(section, ord_piece, ord_role, role, piece, feature)``; the edge sorts first with a blank piece.
    Only pieces with a pia are exported. Several polygons of a piece and role form one feature.
    """
    key = ["section", "piece"]
    modes = piece_mode(merged.unionByName(shapes.filter(F.col("role").isin(*POLYGON_ROLES)), allowMissingColumns=True))
    edge = single_edges(shapes).select(
        "section", F.lit("").alias("piece"), F.lit("side").alias("role"), _geometry("LineString", _line_json("edge")).alias("geometry")
    )
    lines = merged.select(*key, "role", _geometry("LineString", _line_json("vertices")).alias("geometry"))
    polygons = shapes.filter(F.col("role").isin(*POLYGON_ROLES)).groupBy(*key, "role").agg(
        F.sort_array(F.collect_list(F.struct("shape_ord", _polygon_json("vertices").alias("json")))).alias("_all")
    )
    many = F.size("_all") > 1
    texts = F.transform("_all", lambda p: p["json"])
    polygons = polygons.select(*key, "role", F.when(many, _geometry(
        "MultiPolygon", F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    )).otherwise(_geometry("Polygon", F.element_at(texts, 1))).alias("geometry"))
    of_pieces = lines.unionByName(polygons).join(modes, key)
    rows = edge.withColumn("piece_mode", F.lit(None).cast("string")).unionByName(of_pieces)
    names = F.create_map(*[F.lit(v) for pair in ROLE_NAMES.items() for v in pair])
    ranks = F.create_map(*[F.lit(v) for pair in zip(("side", *PIECE_ROLES), range(5)) for v in pair])
    properties = F.struct(
        names[F.col("role")].alias("role"),
        F.col("role").alias("annotation_role"),
        F.when(F.col("piece") != "", F.col("piece")).alias("tissue_piece_id"),
        F.col("piece_mode").alias("piece_mode"),
        F.lit(dataset).cast("string").alias("dataset"),
    )
    return rows.select(
        "section",
        F.col("piece").alias("ord_piece"),
        ranks[F.col("role")].cast("bigint").alias("ord_role"),
        "role",
        F.when(F.col("piece") != "", F.col("piece")).alias("piece"),
        _feature(properties, F.col("geometry")).alias("feature"),
    )


def check_annotations(annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rules at once: (usable shapes, merged lines, findings).

    Shapes, their own errors and the merged lines are each read by many rules, so they are stored once.
    """
    shapes = materialize(canonical(annotations))
    own = materialize(check_lines(shapes).unionByName(check_polygons(shapes)))
    usable = materialize(usable_shapes(shapes, own))
    merged, merging = merge_piece_lines(usable)
    # Relations are judged on merged lines plus the other shapes.
    others = usable.filter(~F.col("role").isin("pia", "wm"))
    lines = merged.select("section", "role", "piece", F.lit(0).cast("bigint").alias("shape_ord"), "vertices")
    whole = others.unionByName(lines)
    ribbons, building = ribbon_from_edge(merged, usable)
    has_pia = merged.filter(F.col("role") == "pia").select("section", "piece")
    explicit = usable.filter(F.col("role") == "ribbon").join(has_pia, ["section", "piece"], "left_semi")
    polygons = ribbons.filter(F.col("ring").isNotNull()).select("section", "piece", F.col("ring").alias("vertices")).unionByName(
        explicit.select("section", "piece", "vertices")
    )
    parts = [
        own, merging, piece_rule_errors(usable, shapes), boundary_crossings(whole), exclusion_contacts(whole),
        endpoint_gap_findings(endpoint_gaps(whole)), building, piece_overlap_findings(piece_overlaps(polygons)),
    ]
    found = parts[0]
    for one in parts[1:]:
        found = found.unionByName(one)
    return usable, merged, found.distinct()


# -- Objects ------------------------------------------------------------------------------------

def object_ids(objects: DataFrame, order: tuple[str, ...] = ("object_type", "shape_ord")) -> DataFrame:
    """Give every object an id: its own, or ``{type}_{n:04d}`` with n from its place in its set, by ``order``.

    A number whose id was given to another object of the section is skipped, and the numbers after
    it move up. All counting is by running totals that carry over partitions, so one very large set
    of objects is no single task.
    """
    own = F.when(strip("object_id") != "", strip("object_id"))
    base = objects.withColumns({"_given": own, "_safe": safe_identifier(strip("object_type"))}).withColumn("_one", F.lit(1))
    key = ["section", "_safe"]
    placed = running_in_group(base, key, list(order), "_one", "_idx", inclusive=True)
    number = F.regexp_extract("_given", r"^(.+)_(\d{4}|[1-9]\d{4,17})$", 2)
    taken = placed.filter(F.col("_given").isNotNull() & (number != "") & (number != "0000")).select(
        "section",
        F.regexp_extract("_given", r"^(.+)_(\d{4}|[1-9]\d{4,17})$", 1).alias("_safe"),
        number.cast("bigint").alias("_pos"),
    ).distinct()
    if taken.isEmpty():
        return placed.select(
            *[F.col(c) for c in objects.columns if c != "object_id"], F.coalesce("_given", _numbered(F.col("_idx"))).alias("object_id")
        )
    # Rows and taken numbers on one line: a row counts the given rows and taken numbers before it.
    rows = placed.select(*key, F.col("_idx").alias("_at"), F.lit(0).alias("_kind"), F.col("_given").isNotNull().cast("int").alias("_delta"))
    marks = taken.select(*key, F.col("_pos").alias("_at"), F.lit(1).alias("_kind"), F.lit(-1).alias("_delta"))
    shifts = running_in_group(rows.unionByName(marks), key, ["_at", "_kind"], "_delta", "_d")
    ranks = running_in_group(
        marks.withColumn("_m", F.lit(1)), key, ["_at"], "_m", "_before"
    ).select(*key, (F.col("_at") - F.col("_before")).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_idx"), F.col("_at").alias("_tie"))
    wanted = shifts.filter((F.col("_kind") == 0) & (F.col("_delta") == 0)).select(*key, F.col("_at").alias("_idx"), "_d")
    pushed = running_in_group(wanted, key, ["_idx"], "_d", "_push", how="max", inclusive=True)
    # Free numbers are counted from 1; a row takes free number ``idx - given before + push``.
    given_before = running_in_group(
        rows.filter("_kind = 0"), key, ["_at"], "_delta", "_g"
    ).select(*key, F.col("_at").alias("_idx"), "_g")
    asks = pushed.join(given_before, [*key, "_idx"]).select(
        *key, (F.col("_idx") - F.col("_g") + F.col("_push")).alias("_at"), F.lit(1).alias("_kind"), "_idx", F.col("_idx").alias("_tie")
    )
    line = ranks.unionByName(asks).withColumn("_mark", (F.col("_kind") == 0).cast("int"))
    numbered = running_in_group(line, key, ["_at", "_kind", "_tie"], "_mark", "_skip").filter("_kind = 1").select(
        *key, "_idx", (F.col("_at") + F.col("_skip")).alias("_n")
    )
    joined = placed.join(numbered, [*key, "_idx"], "left")
    return joined.select(
        *[F.col(c) for c in objects.columns if c != "object_id"], F.coalesce("_given", _numbered(F.col("_n"))).alias("object_id")
    )


def _numbered(n: Column) -> Column:
    digits = F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return F.concat(F.col("_safe"), F.lit("_"), digits)


def object_features(objects: DataFrame, dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of named polygon sets and the findings about them.

    ``objects(section, object_type, object_id, shape_ord, vertices)``; an empty set is one row with null
    vertices. Returns ``(section, object_type, object_id, shape_ord, feature)`` and findings.
    """
    named = objects.withColumns({
        "object_type": strip("object_type"),
        "shape_ord": F.col("shape_ord").cast("bigint"),
        "vertices": F.expr(g.drop_repeats("vertices")),
    })
    blank = F.coalesce(F.col("object_type") == "", F.lit(True))
    blanks = _finding(named.filter(blank).select("section").distinct(), "error", "blank_name", F.lit(TEXTS["blank_name"]))
    filled = named.filter(~blank)
    shapes = materialize(filled.filter(F.col("vertices").isNotNull()))
    sets = filled.groupBy("section", "object_type").agg(F.count("vertices").alias("_n")).filter("_n = 0")
    empty = _finding(sets, "warning", "empty_set", F.concat(
        F.col("object_type"), F.lit(TEXTS["empty_set"])))
    key = ["section", "object_type", "shape_ord"]
    label = F.concat(F.col("object_type"), F.lit(" polygon "), (F.col("shape_ord") + 1).cast("string"))
    bad = check_polygons(shapes, key, label)
    # Invalid polygons keep their place in the count of their set, but are not exported.
    broken = bad_polygons(shapes, key)
    with_ids = materialize(object_ids(shapes).join(broken, key, "left_anti"))
    per_id = with_ids.groupBy("section", "object_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("object_type", "shape_ord")).alias("_first"))
    doubled = _finding(per_id.filter("_n > 1"), "error", "duplicate_id", F.concat(
        F.col("object_id"), F.lit(TEXTS["duplicate_id"])))
    kept = with_ids.join(per_id.select("section", "object_id", "_first"), ["section", "object_id"]).filter(
        F.struct("object_type", "shape_ord") == F.col("_first"))
    none = named.select("section").distinct().join(kept.select("section"), "section", "left_anti")
    nothing = _finding(none, "error", "no_objects", F.lit(TEXTS["no_objects"]))
    properties = F.struct(
        F.lit("analysis_object").alias("role"),
        F.lit("object").alias("annotation_role"),
        F.col("object_id").alias("object_id"),
        F.col("object_type").alias("object_type"),
        F.col("object_type").alias("name"),
        F.lit(dataset).cast("string").alias("dataset"),
    )
    features = kept.select("section", "object_type", "object_id", "shape_ord", _feature(
        properties, _geometry("Polygon", _polygon_json("vertices"))).alias("feature"))
    found = blanks.unionByName(empty).unionByName(bad).unionByName(doubled).unionByName(nothing)
    return features, found.distinct()


def bad_polygons(shapes: DataFrame, key: list[str]) -> DataFrame:
    plain = F.expr(f"NOT {g.all_finite('vertices')} OR CASE WHEN size(vertices) < 3 THEN true ELSE {g.ring_area('vertices')} <= 0 END")
    judged = shapes.withColumn("_plain", plain)
    return judged.filter("_plain").select(*key).unionByName(_self_touching(judged.filter("NOT _plain"), key).select(*key))
