"""Queries over per-cell tables, the element catalogue and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import affine
from cytoplane.functions import geometry as g
from cytoplane.functions.bins import value_bin
from cytoplane.functions.text import derived_key, piece_id_or_default, safe_identifier, split_neurons
from cytoplane.operators import celltypes as ct
from cytoplane.plans import adapters as a
from cytoplane.plans.adapters import oracle
from cytoplane.plans.registry import query, scratch
from cytoplane.sources import catalog, derived, tables
from cytoplane.sources.cells import drop_derived_elements
from cytoplane.functions.text import DERIVED_PREFIX


def _types(spark, sf):
    return tables.scan_cell_types(a.cell_types_raw(spark, sf))


@query("""
    SELECT c_custkey AS label_id, CAST(r_regionkey AS BIGINT) AS column_index, c_acctbal + r_regionkey AS value,
           CASE WHEN r_regionkey = 0 THEN 'given' ELSE 'stain__' || r_name || '__mean' END AS feature, 'stain' AS image_key, r_name AS channel, 'mean' AS statistic
    FROM customer CROSS JOIN region""")
def scan_quantification(spark, sf):
    obs = a.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("label_id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("c_acctbal") + i).alias("values"))
    var = a.table(spark, sf, "region").select(
        F.col("r_regionkey").alias("column_index"), F.lit("stain").alias("image_key"), F.col("r_name").alias("channel"),
        F.lit("mean").alias("statistic"), F.when(F.col("r_regionkey") == 0, "given").alias("feature"))
    return tables.scan_quantification(obs, var)


@query(oracle("SELECT cell_id, broad, fine FROM cell_types_v", "cell_types_v"))
def scan_cell_types(spark, sf):
    return _types(spark, sf)


@query(oracle("""
    SELECT gene, broad, CASE WHEN length(gene) % 4 = 3 THEN '' ELSE fine END AS fine
    FROM marker_reference_v WHERE length(gene) % 7 <> 0""", "marker_reference_v"))
def scan_marker_reference(spark, sf):
    ref = a.marker_reference(spark, sf)
    kind = F.length("gene") % 4

    def doc(value):
        return F.to_json(F.map_from_arrays(F.array("gene"), F.array(value)))

    plain = doc(F.struct("broad", "fine"))
    wrapped = F.concat(F.lit('{"genes":'), plain, F.lit("}"))
    pair = doc(F.array("broad", "fine"))
    aliased = doc(F.struct(F.lit("").alias("broad"), F.col("broad").alias("broad_cell_type")))
    text = F.when(F.length("gene") % 7 == 0, F.lit("not json")).when(kind == 0, plain).when(kind == 1, wrapped).when(kind == 2, pair).otherwise(aliased)
    return tables.scan_marker_reference(ref.select(text.alias("text")))


@query(oracle("""
    SELECT 'json' AS section, gene, broad, fine FROM marker_reference_v
    UNION ALL SELECT 'columns', gene, upper(broad), CASE WHEN length(gene) % 3 = 0 THEN '' ELSE fine END
    FROM marker_reference_v WHERE length(gene) % 5 <> 0""", "marker_reference_v"))
def resolve_marker_reference(spark, sf):
    """Three sections: one with JSON and columns, one with text that is no JSON and columns, one with neither."""
    ref = a.marker_reference(spark, sf)
    text = F.to_json(F.map_from_arrays(F.array("gene"), F.array(F.struct("broad", "fine"))))
    texts = ref.select(F.lit("json").alias("section"), text.alias("text"))
    for section in ("columns", "none"):
        texts = texts.union(ref.limit(1).select(F.lit(section), F.lit("{ not json")))
    var = ref.select(
        F.explode(F.array(F.lit("json"), F.lit("columns"))).alias("section"), "gene",
        F.when(F.length("gene") % 5 == 0, "NaN").otherwise(F.upper("broad")).alias("broad_cell_type"),
        F.when(F.length("gene") % 3 == 0, "None").otherwise(F.col("fine")).alias("fine_cell_type"), F.lit(1).alias("var_ord"))
    older = var.withColumns({"broad_cell_type": F.lit("zz older"), "var_ord": F.lit(0)}).filter(F.length("gene") % 5 != 0)
    return tables.resolve_marker_reference(texts, var.union(older))


@query("""
    SELECT n_name AS section, CAST(0.5 AS DOUBLE) AS a, round(-0.0625 * k, 6) + 0 AS b, round(-5 + 0.0625 * k * k, 6) AS c,
           CAST(0 AS DOUBLE) AS d, CAST(0.25 AS DOUBLE) AS e, round(-0.25 * k, 6) + 0 AS f
    FROM (SELECT n_name, CAST(n_nationkey AS DOUBLE) AS k FROM nation WHERE n_nationkey % 2 = 0) AS q
    UNION ALL
    SELECT n_name, round(s, 6), 0.0, 0.0, 0.0, round(s, 6), 0.0
    FROM (SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 0.2125 ELSE 0.2 + n_nationkey / CAST(64 AS DOUBLE) END AS s FROM nation WHERE n_nationkey % 2 = 1) AS q""")
def scan_pixel_transform(spark, sf):
    n = a.table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("double").cast("string")
    matrix = F.concat(F.lit("2.0 "), (F.col("n_nationkey") * 0.5).cast("string"), F.lit(" 10.0\n0.0 4.0\t"), k, F.lit("\n0 0 1\n"))
    spec = F.when(F.col("n_nationkey") % 3 == 0, F.lit('{"other": 1}')).otherwise(
        F.concat(F.lit('{"pixel_size": '), (F.lit(0.2) + F.col("n_nationkey") / F.lit(64.0)).cast("string"), F.lit("}")))
    even = tables.transforms_from_matrix(n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("section"), matrix.alias("text")))
    odd = tables.transforms_from_spec(n.filter("n_nationkey % 2 = 1").select(F.col("n_name").alias("section"), spec.alias("text")))
    both = even.unionByName(odd)
    return both.select("section", *[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in affine.NAMES])


@query(oracle("""
    SELECT section, family, string_agg(key, '|' ORDER BY key) AS keys FROM (SELECT DISTINCT * FROM elements_v) AS q GROUP BY ALL""", "elements_v"))
def element_catalog(spark, sf):
    return catalog.element_catalog(a.elements(spark, sf)).withColumn("keys", F.array_join("keys", "|"))


_SHAPES = "SELECT DISTINCT section, key FROM elements_v WHERE family = 'shapes'"
_RANK = """CASE WHEN key = 'table_MOSAIK_proseg' THEN 0 WHEN key LIKE 'table\\_MOSAIK\\_proseg\\_%' ESCAPE '\\' THEN 1
    WHEN key = 'MOSAIK_proseg' THEN 2 WHEN key LIKE 'MOSAIK\\_proseg\\_%' ESCAPE '\\' THEN 3 WHEN key = 'cell_boundaries' THEN 4
    WHEN key LIKE 'cell\\_boundaries\\_%' ESCAPE '\\' THEN 5 WHEN key = 'table_original' THEN 6
    WHEN key LIKE 'table\\_original\\_%' ESCAPE '\\' THEN 7 ELSE 8 END"""


def _shapes(spark, sf):
    return a.elements(spark, sf).filter("family = 'shapes'")


@query(oracle(f"SELECT section, arg_min(key, ({_RANK}, key)) AS key FROM shapes_v GROUP BY section", "elements_v", shapes_v=_SHAPES))
def preferred_element(spark, sf):
    return catalog.preferred_element(_shapes(spark, sf))


@query(oracle("""
    SELECT DISTINCT section, key FROM (
      SELECT section, arg_min(key, (key <> 'MOSAIK_cellpose', key)) AS key FROM shapes_v WHERE lower(key) LIKE '%cellpose%' GROUP BY section
      UNION ALL SELECT section, arg_min(key, (key <> 'MOSAIK_proseg', key)) FROM shapes_v WHERE lower(key) LIKE '%proseg%' GROUP BY section) AS q""",
    "elements_v", shapes_v=_SHAPES))
def startup_segmentations(spark, sf):
    return catalog.startup_segmentations(_shapes(spark, sf))


_INSPECTED = """
    SELECT section, arg_min(key, (CASE WHEN lower(key) LIKE '%proseg%' THEN 0 WHEN lower(key) LIKE '%cellpose%' THEN 1
                                       WHEN lower(key) LIKE '%cell%' THEN 2 ELSE 3 END, key)) AS key FROM shapes_v GROUP BY section"""


@query(oracle(_INSPECTED, "elements_v", shapes_v=_SHAPES))
def inspected_segmentation(spark, sf):
    return catalog.inspected_segmentation(_shapes(spark, sf))


_RESOLVED = """
    SELECT s.section, source,
           CASE source WHEN 'proseg' THEN max(CASE WHEN key = 'table_MOSAIK_proseg_clustering_squidpy' THEN key END)
                WHEN 'proseg_mask' THEN max(CASE WHEN key = 'table_MOSAIK_proseg_mask_counts_clustering_squidpy' THEN key END)
                WHEN 'cellpose' THEN max(CASE WHEN key = 'table_MOSAIK_cellpose_clustering_squidpy' THEN key END)
                ELSE max(CASE WHEN key = 'table_original_clustering_squidpy' THEN key END) END AS table_key,
           CASE source WHEN 'proseg' THEN max(CASE WHEN key = 'MOSAIK_proseg' THEN key END)
                WHEN 'proseg_mask' THEN max(CASE WHEN key = 'MOSAIK_proseg' THEN key END)
                WHEN 'cellpose' THEN max(CASE WHEN key = 'MOSAIK_cellpose' THEN key END)
                ELSE coalesce(max(CASE WHEN key = 'merscope_cell_boundaries' THEN key END), max(CASE WHEN key = 'cell_boundaries' THEN key END)) END AS mask_key
    FROM elements_v AS s CROSS JOIN (VALUES ('proseg'), ('proseg_mask'), ('cellpose'), ('original')) AS v(source) GROUP BY s.section, source"""


@query(oracle(_RESOLVED, "elements_v"))
def resolve_cell_type_source(spark, sf):
    return catalog.resolve_cell_type_source(a.elements(spark, sf))


@query(oracle(f"""
    SELECT i.section, arg_min(r.source, CASE r.source WHEN 'proseg' THEN 0 WHEN 'proseg_mask' THEN -1 WHEN 'cellpose' THEN 2 ELSE 3 END) AS source
    FROM ({_INSPECTED}) AS i JOIN ({_RESOLVED}) AS r ON r.section = i.section
    WHERE r.table_key IS NOT NULL AND ((i.key = 'MOSAIK_proseg' AND r.source IN ('proseg', 'proseg_mask'))
       OR (i.key = 'MOSAIK_cellpose' AND r.source = 'cellpose') OR (i.key IN ('merscope_cell_boundaries', 'cell_boundaries') AND r.source = 'original'))
    GROUP BY i.section""", "elements_v", shapes_v=_SHAPES))
def annotation_source(spark, sf):
    resolved = catalog.resolve_cell_type_source(a.elements(spark, sf))
    return catalog.annotation_source(resolved, catalog.inspected_segmentation(_shapes(spark, sf)), selected="proseg_mask")


_STAT = "CASE c_nationkey % 7 WHEN 0 THEN 'iqr' WHEN 1 THEN 'max' WHEN 2 THEN 'mean' WHEN 3 THEN 'median' WHEN 4 THEN 'min' WHEN 5 THEN 'sum' ELSE 'area' END"


@query(f"""
    SELECT DISTINCT 'channel' AS kind, 0 AS rank, c_mktsegment AS name FROM customer
    UNION ALL SELECT DISTINCT 'statistic', CASE s WHEN 'min' THEN 0 WHEN 'median' THEN 1 WHEN 'mean' THEN 2 WHEN 'max' THEN 3 WHEN 'iqr' THEN 4 ELSE 5 END, s
    FROM (SELECT {_STAT} AS s FROM customer) AS q""")
def quantification_options(spark, sf):
    rows = a.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("channel"), F.expr(_STAT).alias("statistic"))
    return catalog.quantification_options(rows)


@query("""
    SELECT r_name AS section, n_name AS image_key, 'ch' || (n_nationkey % 4) AS channel,
           CASE WHEN count(*) OVER (PARTITION BY r_name, n_nationkey % 4) > 1 THEN n_name || ': ch' || (n_nationkey % 4)
                ELSE 'ch' || (n_nationkey % 4) END AS display_name
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def channel_display_name(spark, sf):
    n, r = a.table(spark, sf, "nation"), a.table(spark, sf, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("section"), F.col("n_name").alias("image_key"),
        F.concat(F.lit("ch"), (F.col("n_nationkey") % 4).cast("string")).alias("channel"))
    return catalog.channel_display_name(rows)


def _var(spark, sf):
    """One feature per supplier: many columns, several per (channel, statistic)."""
    s, n, r = (a.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_name").alias("feature"), F.lit("stain").alias("image_key"), F.col("r_name").alias("channel"),
        F.when(F.col("s_suppkey") % 2 == 0, "Mean").otherwise("max").alias("statistic"), F.col("s_suppkey").alias("column_index"))


@query("""
    SELECT arg_min(s_name, s_suppkey) AS feature, min(s_suppkey) AS column_index
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND s_suppkey % 2 = 0 HAVING count(*) > 0""")
def resolve_feature(spark, sf):
    return ct.resolve_feature(_var(spark, sf), "asia", "MEAN")


@query("""
    SELECT o_custkey AS label_id, o_totalprice AS value FROM orders
    WHERE o_orderkey % 100 = (SELECT min(s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                              WHERE r_name = 'AFRICA' AND s_suppkey % 2 = 1)""")
def select_quantification(spark, sf):
    values = a.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("label_id"), (F.col("o_orderkey") % 100).alias("column_index"), F.col("o_totalprice").alias("value"))
    return ct.select_quantification(values, _var(spark, sf), "Africa", "MAX")


@query(oracle("""
    SELECT cell_id, broad, fine FROM cell_types_v WHERE broad IN (SELECT DISTINCT broad FROM cell_types_v WHERE length(broad) % 2 = 0)""", "cell_types_v"))
def enabled_cell_types(spark, sf):
    types = _types(spark, sf)
    on = types.select(F.col("broad").alias("label")).filter(F.length("label") % 2 == 0)
    return ct.enabled_cell_types(types, on).select("cell_id", "broad", "fine")


@query(oracle("SELECT DISTINCT section, family, key FROM elements_v WHERE NOT starts_with(key, '_derived_')", "elements_v"), name="drop_derived_elements")
def drop_derived(spark, sf):
    return drop_derived_elements(a.elements(spark, sf).distinct(), DERIVED_PREFIX)


@query(oracle("""
    SELECT CAST(cell AS BIGINT) AS cell_id, broad_class AS broad, CASE WHEN hierarchical_cluster = 'none' THEN broad_class ELSE hierarchical_cluster END AS fine
    FROM cell_types_raw_v WHERE broad_class <> 'nan' AND CAST(cell AS BIGINT) % 5 <> 0""", "cell_types_raw_v"))
def drop_missing_labels(spark, sf):
    raw = a.cell_types_raw(spark, sf)
    number = F.col("cell").cast("bigint")
    return ct.drop_missing_labels(raw.select(
        F.when(number % 5 != 0, number).alias("cell_id"), F.col("broad_class").alias("broad"), F.col("hierarchical_cluster").alias("fine")))


@query(oracle("""
    SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, coalesce(broad, 'Unannotated') AS broad, coalesce(fine, 'Unannotated') AS fine
    FROM supplier LEFT JOIN cell_types_v ON cell_id = s_suppkey""", "cell_types_v"))
def annotate_cells(spark, sf):
    cells = a.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("cell_id"))
    return ct.annotate_cells(cells, _types(spark, sf))


@query(oracle("SELECT broad AS label, count(*) AS n FROM cell_types_v GROUP BY broad", "cell_types_v"))
def cell_type_counts(spark, sf):
    return ct.cell_type_counts(_types(spark, sf))


@query(oracle("""
    SELECT channel, round(quantile_cont(value, 0.01), 6) AS clip_low, round(quantile_cont(value, 0.99), 6) AS clip_high
    FROM features_v WHERE NOT isnan(value) GROUP BY channel""", "features_v"))
def value_clip_range(spark, sf):
    return _round(ct.value_clip_range(a.features(spark, sf), ["channel"]), "clip_low", "clip_high")


def _round(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


_LIMITS = """SELECT channel, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM features_v WHERE NOT isnan(value) GROUP BY channel"""
_BINNED = """
    SELECT label_id, f.channel, value,
           CAST(CASE WHEN hi <= lo THEN 128 ELSE floor(least(greatest((value - lo) / (hi - lo), 0), 1) * 255) END AS BIGINT) AS bin
    FROM features_v AS f JOIN limits_v AS l ON l.channel = f.channel WHERE NOT isnan(value) AND label_id > 0"""


def _binned(spark, sf):
    values = a.features(spark, sf)
    return ct.binned_values(values, ct.value_clip_range(values, ["channel"]), ["channel"])


@query(oracle("SELECT label_id, channel, bin FROM binned_v", "features_v", limits_v=_LIMITS, binned_v=_BINNED))
def value_bins(spark, sf):
    return _binned(spark, sf).select("label_id", "channel", "bin")


@query(oracle("""
    SELECT f.channel, count(*) AS label_count, count(b.label_id) AS finite_count, count(DISTINCT b.bin) AS bins_used
    FROM features_v AS f LEFT JOIN binned_v AS b ON b.label_id = f.label_id GROUP BY f.channel""", "features_v", limits_v=_LIMITS, binned_v=_BINNED))
def overlay_stats(spark, sf):
    return ct.overlay_stats(a.features(spark, sf), _binned(spark, sf), ["channel"])


@query(oracle("SELECT broad, string_agg(fine, '|' ORDER BY fine) AS fines FROM (SELECT DISTINCT broad, fine FROM cell_types_v) AS q GROUP BY broad", "cell_types_v"))
def type_groups(spark, sf):
    return ct.type_groups(_types(spark, sf)).withColumn("fines", F.array_join("fines", "|"))


_AXIS = "SELECT c_nationkey AS axis, c_custkey AS index, CASE WHEN c_nationkey % 3 = 0 THEN c_custkey * c_custkey + 0.5 ELSE c_custkey * 2.0 + c_nationkey END AS value FROM customer"


@query(oracle("""
    SELECT CAST(axis AS BIGINT) AS axis, round(CAST(min_by(value, index) AS DOUBLE), 6) AS origin,
           round(CASE WHEN count(d) = 0 THEN 1 WHEN max(abs(d - m)) > 1e-6 + 1e-3 * abs(min(m)) THEN arg_min(d, index) FILTER (WHERE d IS NOT NULL) ELSE min(m) END, 6) AS step
    FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY axis) AS m FROM
            (SELECT axis, index, value, lead(value) OVER (PARTITION BY axis ORDER BY index) - value AS d FROM ranked_v) AS q) AS r
    GROUP BY axis""",
    axis_v=_AXIS.replace("2.0", "CAST(2 AS DOUBLE)").replace("0.5", "CAST(0.5 AS DOUBLE)"),
    ranked_v="SELECT axis, CAST(index % 1000000 AS BIGINT) AS index, value FROM (SELECT axis, row_number() OVER (PARTITION BY axis ORDER BY index) - 1 AS index, value FROM axis_v) AS q"))
def grid_origin_step(spark, sf):
    from cytoplane.operators.ordering import running_in_group

    c = a.table(spark, sf, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    raw = c.select(nation.cast("bigint").alias("axis"), key.alias("at"), F.lit(1).alias("one"), F.when(
        nation % 3 == 0, key * key + F.lit(0.5)).otherwise(key * F.lit(2.0) + nation).alias("value"))
    coords = running_in_group(raw, ["axis"], ["at"], "one", "index").select("axis", F.col("index").cast("bigint").alias("index"), "value")
    return _round(ct.grid_origin_step(coords, ["axis"]), "origin", "step")


_SHAPE_IDS = """
    SELECT n_name AS section, CASE WHEN s_nationkey % 3 = 0 THEN 'c' || CAST(s_suppkey % 5 AS VARCHAR(20)) ELSE CAST(s_suppkey AS VARCHAR(20)) END AS cell_id,
           s_suppkey AS shape_ord FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(oracle("""
    SELECT section, cell_id, CASE WHEN starts_with(cell_id, 'c') THEN dense_rank() OVER (PARTITION BY section ORDER BY first)
                                  ELSE try_cast(cell_id AS BIGINT) END AS label_id, false AS wide
    FROM (SELECT section, cell_id, min(shape_ord) AS first FROM shape_ids_v GROUP BY section, cell_id) AS q""", shape_ids_v=_SHAPE_IDS))
def label_ids(spark, sf):
    s, n = a.table(spark, sf, "supplier"), a.table(spark, sf, "nation")
    text = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("c"), (F.col("s_suppkey") % 5).cast("string"))).otherwise(F.col("s_suppkey").cast("string"))
    shapes = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("section"), text.alias("cell_id"), F.col("s_suppkey").alias("shape_ord"))
    return ct.label_ids(shapes, ["section"]).withColumn("label_id", F.col("label_id").cast("bigint"))


_ODD_NAME = "'  --' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (a/b)_' ELSE '' END"


@query(f"""
    SELECT DISTINCT name, lower(trim(regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')) AS safe
    FROM (SELECT {_ODD_NAME} AS name FROM part UNION ALL SELECT p_brand FROM part) AS q""", name="safe_identifier")
def safe_identifiers(spark, sf):
    p = a.table(spark, sf, "part")
    names = p.select(F.expr(_ODD_NAME).alias("name")).union(p.select("p_brand")).distinct()
    return names.withColumn("safe", safe_identifier("name"))


@query("""
    SELECT DISTINCT p_name AS name,
           '_derived_outline__' || replace(p_name, ' ', '_') || CASE WHEN contains(p_name, ' ') THEN '__h' || substr(sha256(p_name), 1, 10) ELSE '' END || '__w3' AS outline_key,
           '_derived_imgpyr__' || p_brand || '__ds4' AS pyramid_key
    FROM (SELECT p_name, replace(p_brand, '#', '_') AS p_brand FROM part) AS q""", name="derived_key")
def derived_keys(spark, sf):
    p = a.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand")).distinct()
    return p.select("name", derived_key("outline", "name", "w3").alias("outline_key"), derived_key("imgpyr", "brand", "ds4").alias("pyramid_key"))


@query(oracle("""
    SELECT cell, CASE WHEN broad_class = 'neurons' AND neuron_split_label = 'Excitatory' THEN 'Excitatory neurons'
                      WHEN broad_class = 'neurons' AND neuron_split_label = 'Inhibitory' THEN 'Inhibitory neurons' ELSE broad_class END AS broad
    FROM cell_types_raw_v""", "cell_types_raw_v"), name="split_neurons")
def neurons_split(spark, sf):
    raw = a.cell_types_raw(spark, sf)
    return raw.select("cell", split_neurons("broad_class", F.coalesce("neuron_split_label", F.lit(""))).alias("broad"))


@query("""
    SELECT vec_id, round(2*px - py/2 + 7, 6) AS x, round(px/4 + 4*py - 3, 6) AS y, round(px, 6) AS px_back, round(py, 6) AS py_back
    FROM (SELECT vec_id, CAST(10 + 3*vec_id AS DOUBLE) AS px, CAST(5 + 2*label AS DOUBLE) AS py FROM embeddings) AS q""")
def apply_affine(spark, sf):
    base = affine.literal(a=2.0, b=-0.5, c=7.0, d=0.25, e=4.0, f=-3.0)
    grid = affine.with_grid(base, x_origin=10, x_step=3, y_origin=5, y_step=2)
    e = a.table(spark, sf, "embeddings").select("vec_id", "label")
    x, y = affine.apply(grid, F.col("vec_id"), F.col("label"))
    moved = e.withColumns({"x": x, "y": y})
    back = affine.apply(affine.invert(base), F.col("x"), F.col("y"))
    return _round(moved.withColumns({"px_back": back[0], "py_back": back[1]}).drop("label"), "x", "y", "px_back", "py_back")


@query("""
    SELECT vec_id, round(least(x00, x01, x10, x11), 6) AS xmin, round(least(y00, y01, y10, y11), 6) AS ymin,
           round(greatest(x00, x01, x10, x11), 6) AS xmax, round(greatest(y00, y01, y10, y11), 6) AS ymax
    FROM (SELECT vec_id, 2.0*c0 - r0 AS x00, 2.0*c1 - r0 AS x01, 2.0*c0 - r1 AS x10, 2.0*c1 - r1 AS x11,
                 c0 + 3.0*r0 AS y00, c1 + 3.0*r0 AS y01, c0 + 3.0*r1 AS y10, c1 + 3.0*r1 AS y11
          FROM (SELECT vec_id, CAST(vec_id AS DOUBLE) AS r0, vec_id + 5.0 AS r1, CAST(label AS DOUBLE) AS c0, label + 10.0 AS c1 FROM embeddings) AS q) AS p""")
def tile_bounds(spark, sf):
    e = a.table(spark, sf, "embeddings").select("vec_id", "label")
    t = affine.literal(a=2.0, b=-1.0, c=0.0, d=1.0, e=3.0, f=0.0)
    row, col = F.col("vec_id").cast("double"), F.col("label").cast("double")
    return _round(e.select("vec_id", *[v.alias(k) for k, v in affine.window_bounds(t, row, row + 5, col, col + 10).items()]), "xmin", "ymin", "xmax", "ymax")


_RING = "round({0}, 3) || ' ' || round({1}, 3)"


@query(oracle("""
    SELECT cell_id, CASE WHEN sq THEN 5 ELSE 4 + 1 END AS n_closed, round(cy, 6) AS centre_x, round(cx, 6) AS centre_y FROM cells_v""", "cells_v"), name="swap_xy_close_ring")
def swap_and_close(spark, sf):
    opened = "slice(parts[0].exterior, 1, size(parts[0].exterior) - 1)"
    again = g.close_ring(g.close_ring(g.swap_xy(opened)))
    rows = a.cells(spark, sf).select(
        F.col("cell_id").cast("bigint").alias("cell_id"),
        F.expr(f"size({again})").alias("n_closed"),
        F.expr(f"aggregate({g.swap_xy(opened)}, 0D, (s, v) -> s + v.x / 4)").alias("centre_x"),
        F.expr(f"aggregate({g.swap_xy(opened)}, 0D, (s, v) -> s + v.y / 4)").alias("centre_y"),
    )
    return _round(rows, "centre_x", "centre_y")


@query("""
    SELECT c_custkey, CAST(CASE WHEN hi <= lo THEN 8 ELSE floor(least(greatest((c_acctbal - lo) / (hi - lo), 0), 1) * 15) END AS BIGINT) AS bin
    FROM (SELECT c_custkey, c_acctbal, CAST(c_nationkey * 100 AS DOUBLE) AS lo, CASE WHEN c_nationkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE 5000.0 + c_nationkey END AS hi FROM customer) AS q""", name="value_bin")
def value_bin_function(spark, sf):
    c = a.table(spark, sf, "customer")
    low = (F.col("c_nationkey") * 100).cast("double")
    high = F.when(F.col("c_nationkey") % 6 == 0, F.lit(0.0)).otherwise(F.lit(5000.0) + F.col("c_nationkey"))
    return c.select("c_custkey", value_bin(F.col("c_acctbal"), low, high, 16).alias("bin"))


@query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'piece_1' WHEN 1 THEN 'piece_1' ELSE s_name END AS piece FROM supplier""")
def piece_id_default(spark, sf):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("  ")).when(k == 2, F.concat(F.lit(" "), "s_name", F.lit("\t"))).otherwise(F.col("s_name"))
    return a.table(spark, sf, "supplier").select("s_suppkey", piece_id_or_default(raw).alias("piece"))


@query(oracle("SELECT broad, count(*) AS n, 1 AS builds FROM cell_types_v GROUP BY broad", "cell_types_v"))
def materialize_derived(spark, sf):
    """Built on the first call, reused on the second."""
    path, builds = scratch(spark, "derived"), []

    def build():
        builds.append(1)
        return ct.cell_type_counts(_types(spark, sf)).withColumnRenamed("label", "broad")

    parameters = {"kind": "cell_type_counts", "level": "broad"}
    derived.materialize_derived(spark, path, parameters, build)
    return derived.materialize_derived(spark, path, parameters, build).withColumn("builds", F.lit(len(builds)))
