"""Queries over transcript points and the gene panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions.text import is_control_gene, is_assigned, normalize_cell_key
from cytoplane.operators import layout, sampling
from cytoplane.operators import panel as p
from cytoplane.operators import transcripts as t
from cytoplane.plans import adapters as a
from cytoplane.plans.adapters import oracle
from cytoplane.plans.registry import query, scratch
from cytoplane.session import materialize
from cytoplane.sources import tables
from cytoplane.sources.transcripts import ROW_KEY, canonical_transcripts, union_sections

SAMPLE = 5000

_DIRTY = """
    SELECT CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE gene END AS gene,
           CASE WHEN l_orderkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x,
           CASE WHEN l_orderkey % 51 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE y END AS y
    FROM (SELECT l_orderkey, l_partkey, p_name AS gene, l_quantity AS x, l_extendedprice AS y
          FROM lineitem JOIN part ON p_partkey = l_partkey) AS q"""


@query(oracle("SELECT gene, x, y FROM transcripts_v", "transcripts_v"))
def scan_transcripts(spark, sf):
    return canonical_transcripts(a.transcripts(spark, sf)).select("gene", "x", "y")


@query(oracle("SELECT x, y, gene, assignment, background FROM transcripts_v", "transcripts_v"))
def resolve_columns(spark, sf):
    raw = a.transcripts(spark, sf).select(
        F.col("gene").alias("feature_name"), F.col("x").alias("global_x"), F.col("y").alias("global_y"),
        F.col("assignment").alias("cell"), "background", "platform",
    )
    return canonical_transcripts(raw)


@query(oracle("""
    SELECT CASE platform WHEN 'O' THEN 'MERSCOPE' ELSE 'XENIUM' END AS section, x, y, gene,
           CAST(assignment AS VARCHAR) AS assignment, CASE WHEN platform <> 'O' THEN coalesce(background, false) ELSE NOT (assignment > 0) END AS background
    FROM transcripts_v""", "transcripts_v"), name="union_sections")
def union_of_sections(spark, sf):
    raw = a.transcripts(spark, sf)
    merscope = raw.filter("platform = 'O'").select(
        "gene", F.col("x").alias("global_x"), F.col("y").alias("global_y"), F.col("assignment").alias("cell_id"))
    xenium = raw.filter("platform <> 'O'").select(
        F.col("gene").alias("feature_name"), F.col("x").alias("x_location"), F.col("y").alias("y_location"),
        F.col("assignment").cast("string").alias("cell_id"), "background")
    return union_sections({"MERSCOPE": merscope, "XENIUM": xenium})


def _two_sections(spark, sf):
    """The same cell ids in two sections, one of them without a background column."""
    raw = a.transcripts(spark, sf)
    plain = raw.filter("platform = 'O'").select("gene", "x", "y", "assignment")
    marked = raw.filter("platform <> 'O'").select("gene", "x", "y", "assignment", F.when(F.col("x") < 900, F.col("background")).alias("background"))
    return union_sections({"M": plain, "X": marked})


_SECTIONS = """
    SELECT CASE platform WHEN 'O' THEN 'M' ELSE 'X' END AS section, gene, x, y, CAST(assignment AS VARCHAR) AS cell_id, assignment > 0 AS assigned,
           CASE WHEN platform = 'O' THEN NOT (assignment > 0) ELSE x < 900 AND background END AS background
    FROM transcripts_v"""


@query(oracle("""
    SELECT section, gene, count(*) FILTER (WHERE NOT background) AS fg, count(*) FILTER (WHERE background) AS bg
    FROM sections_v GROUP BY ALL""", "transcripts_v", sections_v=_SECTIONS))
def union_fg_bg(spark, sf):
    both = _two_sections(spark, sf)
    out = [t.gene_fg_bg_counts(both.filter(F.col("section") == s)).select(F.lit(s).alias("section"), "gene", "fg", "bg") for s in ("M", "X")]
    return out[0].union(out[1])


@query(oracle("SELECT section, cell_id, gene, count(*) AS n FROM sections_v WHERE assigned GROUP BY ALL", "transcripts_v", sections_v=_SECTIONS))
def cell_gene_counts_by_section(spark, sf):
    return t.cell_gene_counts(_two_sections(spark, sf))


@query(oracle("""
    SELECT gene, x, y FROM dirty_v
    WHERE NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE) AND NOT isnan(y)
      AND abs(y) < CAST('Infinity' AS DOUBLE) AND gene IS NOT NULL""", dirty_v=_DIRTY))
def valid_points(spark, sf):
    lines, parts = a.table(spark, sf, "lineitem"), a.table(spark, sf, "part")
    dirty = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.when(F.col("l_partkey") % 53 != 0, F.col("p_name")).alias("gene"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"),
        F.when(F.col("l_orderkey") % 51 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("y"),
    )
    return t.valid_points(dirty)


_TEXT_ID = """CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '-1' WHEN 4 THEN 'nan'
    WHEN 5 THEN 'None' WHEN 6 THEN '<NA>' WHEN 7 THEN '0.0' ELSE 'cell' END"""


@query(f"""
    SELECT l_linenumber, text_id, l_suppkey > 0 AS by_number, text_id IN ('0.0', 'cell') AND text_id IS NOT NULL AS by_text,
           count(*) AS n
    FROM (SELECT *, {_TEXT_ID} AS text_id FROM lineitem) AS q GROUP BY ALL""")
def assigned(spark, sf):
    df = a.table(spark, sf, "lineitem").withColumn("text_id", F.expr(_TEXT_ID))
    flags = df.select(
        "l_linenumber", "text_id",
        is_assigned("l_suppkey", df.schema["l_suppkey"].dataType).alias("by_number"),
        is_assigned("text_id", df.schema["text_id"].dataType).alias("by_text"),
    )
    return flags.groupBy("l_linenumber", "text_id", "by_number", "by_text").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("""
    SELECT gene, 'column' AS form, background, count(*) AS n FROM transcripts_v GROUP BY ALL
    UNION ALL SELECT gene, 'assignment', NOT (assignment > 0), count(*) FROM transcripts_v GROUP BY ALL
    UNION ALL SELECT gene, 'none', false, count(*) FROM transcripts_v GROUP BY ALL""", "transcripts_v"))
def background_flag(spark, sf):
    raw = a.transcripts(spark, sf)
    out = None
    for form, columns in (("column", ["background", "assignment"]), ("assignment", ["assignment"]), ("none", [])):
        one = t.with_background(raw.select("gene", *columns)).groupBy("gene", "background").agg(F.count(F.lit(1)).alias("n"))
        one = one.select("gene", F.lit(form).alias("form"), "background", "n")
        out = one if out is None else out.union(one)
    return out


@query(oracle("""
    SELECT DISTINCT gene, lower(gene) LIKE '%blank%' AS is_control FROM transcripts_v""", "transcripts_v"), name="is_control_gene")
def control_genes(spark, sf):
    return t.panel(a.transcripts(spark, sf)).withColumn("is_control", is_control_gene("gene"))


@query(oracle("""
    SELECT gene, x, y, background FROM transcripts_v
    WHERE length(gene) % 2 = 0 AND NOT background AND lower(gene) NOT LIKE '%blank%'""", "transcripts_v"))
def visible_transcripts(spark, sf):
    raw = a.transcripts(spark, sf)
    enabled = t.panel(raw).filter(F.length("gene") % 2 == 0)
    return t.visible_transcripts(raw, enabled, hide_background=True).select("gene", "x", "y", "background")


_ANNOTATED = ("annotated_genes_v",)


@query(oracle("""
    SELECT title, gene, lower(gene) LIKE '%al%' AND lower(gene) NOT LIKE '%blank%' AS shown,
           max(lower(gene) LIKE '%al%' AND lower(gene) NOT LIKE '%blank%') OVER (PARTITION BY title) AS group_shown
    FROM (SELECT gene, CASE WHEN fine <> '' THEN broad || ' — ' || fine ELSE broad END AS title FROM annotated_genes_v) AS q""",
    *_ANNOTATED))
def search_panel(spark, sf):
    return p.search_panel(_members(spark, sf, True).select("title", "gene"), " AL ")


@query(oracle("""
    SELECT title, label, lower(label) LIKE '%ic%' AS shown, max(lower(label) LIKE '%ic%') OVER (PARTITION BY title) AS group_shown
    FROM (SELECT DISTINCT broad AS title, fine AS label FROM cell_types_v) AS q""", "cell_types_v"))
def search_labels(spark, sf):
    types = tables.scan_cell_types(a.cell_types_raw(spark, sf))
    return p.search_labels(types.select(F.col("broad").alias("title"), F.col("fine").alias("label")).distinct(), "IC ")


@query(oracle("""
    SELECT false AS is_control_group, 'Genes' AS broad, 'Genes' AS title, gene FROM
      (SELECT DISTINCT gene FROM transcripts_v UNION ALL SELECT CAST(NULL AS VARCHAR)) AS q""", "transcripts_v"))
def panel_grouped_plain(spark, sf):
    """A reference of other genes: the panel is one group."""
    other = a.marker_reference(spark, sf).withColumn("gene", F.concat(F.lit("other "), "gene"))
    return p.panel_grouped(p.annotate_genes(t.panel(a.transcripts(spark, sf)), other))


def _annotated(spark, sf):
    return p.annotate_genes(t.panel(a.transcripts(spark, sf)), a.marker_reference(spark, sf))


def _members(spark, sf, fine):
    return p.panel_grouped(_annotated(spark, sf), fine).filter("gene IS NOT NULL")


@query(oracle("""
    SELECT gene, broad, fine, CASE WHEN fine <> '' THEN broad || ' / ' || fine ELSE broad END AS cell_type
    FROM annotated_genes_v""", *_ANNOTATED))
def annotate_genes(spark, sf):
    return _annotated(spark, sf)


@query(oracle("""
    SELECT DISTINCT gene FROM transcripts_v WHERE gene NOT IN (SELECT gene FROM marker_reference_v)""",
    "transcripts_v", "marker_reference_v"))
def genes_without_reference(spark, sf):
    return p.genes_without_reference(t.panel(a.transcripts(spark, sf)), a.marker_reference(spark, sf))


@query(oracle("""
    SELECT a.cell_id, a.gene, a.x, a.y FROM assigned_v AS a
    JOIN supplier ON CAST(s_suppkey AS VARCHAR) = a.cell_id WHERE s_nationkey = 3""", "assigned_v"))
def transcripts_for_cells(spark, sf):
    wanted = a.table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("cell_id"))
    unknown = wanted.select((F.col("cell_id") + 1_000_000_000).alias("cell_id"))
    return t.transcripts_for_cells(a.transcripts(spark, sf), wanted.union(unknown)).select("cell_id", "gene", "x", "y")


@query(oracle("""
    SELECT a.cell_id, a.gene, a.x, a.y FROM assigned_v AS a
    JOIN supplier ON CAST(s_suppkey AS VARCHAR) = a.cell_id WHERE s_nationkey = 3""", "assigned_v"))
def look_up_cells(spark, sf):
    """The same from the stored index, opening only the files that hold a requested cell."""
    path = scratch(spark, "cell-index")
    layout.write_cell_index(a.transcripts(spark, sf), path)
    wanted = a.table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("cell_id"))
    return layout.look_up_cells(spark, path, wanted).select("cell_id", "gene", "x", "y")


@query(oracle("SELECT gene, count(*) AS n FROM transcripts_v GROUP BY gene", "transcripts_v"))
def gene_counts(spark, sf):
    return t.gene_counts(a.transcripts(spark, sf))


@query(oracle(f"""
    SELECT count(*) AS source_total, least(count(*), {SAMPLE}) AS rendered_total, count(*) > {SAMPLE} AS sampled
    FROM transcripts_v""", "transcripts_v"))
def point_totals(spark, sf):
    return t.point_totals(a.transcripts(spark, sf), SAMPLE)


@query(oracle("SELECT cell_id, count(*) AS n FROM assigned_v GROUP BY cell_id", "assigned_v"))
def cell_counts(spark, sf):
    return t.cell_counts(a.transcripts(spark, sf))


@query(oracle("SELECT gene, fg, bg FROM gene_fg_bg_v", "gene_fg_bg_v"))
def gene_fg_bg_counts(spark, sf):
    return t.gene_fg_bg_counts(a.transcripts(spark, sf))


@query(oracle("SELECT cell_id, gene, count(*) AS n FROM assigned_v GROUP BY ALL", "assigned_v"))
def cell_gene_counts(spark, sf):
    return t.cell_gene_counts(a.transcripts(spark, sf))


@query(oracle("SELECT cell_id, y, x, gene FROM assigned_v", "assigned_v"))
def cell_transcripts(spark, sf):
    return t.cell_transcripts(a.transcripts(spark, sf))


@query(oracle("""
    SELECT cell_id, CAST(sum(n) OVER (ORDER BY cell_id) - n AS BIGINT) AS "start", CAST(sum(n) OVER (ORDER BY cell_id) AS BIGINT) AS "end"
    FROM (SELECT cell_id, count(*) AS n FROM assigned_v GROUP BY cell_id) AS q""", "assigned_v"))
def cell_slices(spark, sf):
    return t.cell_slices(a.transcripts(spark, sf))


@query(oracle("""
    SELECT broad, string_agg(gene, '|' ORDER BY gene) AS genes, count(*) AS n FROM annotated_genes_v GROUP BY broad""", *_ANNOTATED))
def gene_groups(spark, sf):
    return _flat(p.gene_groups(_annotated(spark, sf)))


@query(oracle("""
    SELECT broad, fine, string_agg(gene, '|' ORDER BY gene) AS genes, count(*) AS n
    FROM annotated_genes_v GROUP BY broad, fine""", *_ANNOTATED))
def gene_groups_fine(spark, sf):
    return _flat(p.gene_groups(_annotated(spark, sf), fine=True))


def _flat(groups):
    return groups.withColumn("n", F.size("genes").cast("bigint")).withColumn("genes", F.array_join("genes", "|"))


@query(oracle("""
    SELECT gene, dense_rank() OVER (ORDER BY gene) - 1 AS gene_code
    FROM (SELECT DISTINCT gene FROM transcripts_v) AS q""", "transcripts_v"))
def gene_codes(spark, sf):
    return t.gene_codes(a.transcripts(spark, sf))


@query(oracle("""
    SELECT gene, dense_rank() OVER (ORDER BY gene) - 1 AS gene_code, (row_number() OVER (ORDER BY gene) - 1) % 14 AS marker_group
    FROM (SELECT DISTINCT gene FROM transcripts_v) AS q""", "transcripts_v"))
def marker_group(spark, sf):
    return t.marker_group(a.transcripts(spark, sf))


_BY_BROAD = "SELECT gene, broad, (row_number() OVER (PARTITION BY broad ORDER BY gene) - 1) % 14 AS marker_group FROM annotated_genes_v"


@query(oracle(_BY_BROAD, *_ANNOTATED))
def marker_group_by_broad(spark, sf):
    return p.marker_group_by_broad(_annotated(spark, sf)).select("gene", "broad", "marker_group")


_OFFSETS = """
    SELECT gene, marker_group, CAST(last - fg - bg AS BIGINT) AS fg_start, CAST(last - bg AS BIGINT) AS fg_end, CAST(last AS BIGINT) AS bg_end
    FROM (SELECT c.gene, marker_group, fg, bg, sum(fg + bg) OVER (PARTITION BY marker_group ORDER BY c.gene) AS last
          FROM gene_fg_bg_v AS c JOIN groups_v AS g ON g.gene = c.gene) AS q"""


@query(oracle(_OFFSETS, "gene_fg_bg_v", "annotated_genes_v", groups_v=_BY_BROAD))
def gene_offsets(spark, sf):
    groups = p.marker_group_by_broad(_annotated(spark, sf))
    return t.gene_offsets(t.gene_fg_bg_counts(a.transcripts(spark, sf)), groups)


@query(oracle("""
    SELECT cell_id, gene, n, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, gene) AS rank
    FROM (SELECT cell_id, gene, count(*) AS n FROM assigned_v GROUP BY ALL) AS q""", "assigned_v"))
def ranked_genes(spark, sf):
    return t.ranked_genes(t.cell_gene_counts(a.transcripts(spark, sf)))


@query(oracle("""
    SELECT cell_id, gene, n, round(n / CAST(sum(n) OVER (PARTITION BY cell_id) AS DOUBLE), 6) AS share
    FROM (SELECT cell_id, gene, count(*) AS n FROM assigned_v GROUP BY ALL) AS q""", "assigned_v"))
def gene_share(spark, sf):
    return t.gene_share(t.cell_gene_counts(a.transcripts(spark, sf))).withColumn("share", F.round("share", 6))


@query(oracle("SELECT DISTINCT gene FROM transcripts_v ORDER BY gene", "transcripts_v"))
def panel_alphabetical(spark, sf):
    return t.panel_alphabetical(a.transcripts(spark, sf))


@query(oracle("""
    SELECT is_control_group, broad, title, gene FROM
      (SELECT broad = 'Control / blank probes' AS is_control_group, broad, broad AS title, gene FROM annotated_genes_v
       UNION ALL SELECT DISTINCT broad = 'Control / blank probes', broad, broad, CAST(NULL AS VARCHAR) FROM annotated_genes_v) AS q
    """, *_ANNOTATED))
def panel_grouped(spark, sf):
    return p.panel_grouped(_annotated(spark, sf))


@query(oracle("""
    SELECT is_control_group, broad, fine, CASE WHEN fine <> '' THEN broad || ' — ' || fine ELSE broad END AS title, gene FROM
      (SELECT broad = 'Control / blank probes' AS is_control_group, broad, fine, gene FROM annotated_genes_v
       UNION ALL SELECT DISTINCT broad = 'Control / blank probes', broad, fine, CAST(NULL AS VARCHAR) FROM annotated_genes_v) AS q
    """, *_ANNOTATED))
def panel_grouped_fine(spark, sf):
    return p.panel_grouped(_annotated(spark, sf), fine=True)


@query(oracle(f"""
    SELECT least(count(*), {SAMPLE}) AS n_rows, least(count(*), {SAMPLE}) AS n_distinct_keys,
           least(count(*), {SAMPLE}) AS n_in_source, least(count(*), {SAMPLE}) AS n_same_again FROM transcripts_v""", "transcripts_v"))
def exact_sample(spark, sf):
    """Size, subset and repeatability of the sample (the drawn rows themselves have no SQL form)."""
    source = a.transcripts(spark, sf, row_key=True)
    key = list(ROW_KEY)
    drawn = sampling.exact_sample(source, SAMPLE, 42, key)
    again = sampling.exact_sample(source, SAMPLE, 42, key).select(*key, F.lit(True).alias("again"))
    known = source.select(*key, F.col("gene").alias("known"))
    joined = drawn.join(known, key, "left").join(again, key, "left")
    return joined.groupBy(*key).agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("known") == F.col("gene"), 1)).alias("k"), F.count("again").alias("g")
    ).agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_keys"), F.sum("k").alias("n_in_source"), F.sum("g").alias("n_same_again")
    )


@query(oracle("""
    SELECT t.gene, x, y, background, marker_group, gene_code FROM transcripts_v AS t JOIN
      (SELECT gene, dense_rank() OVER (ORDER BY gene) - 1 AS gene_code, (dense_rank() OVER (ORDER BY gene) - 1) % 14 AS marker_group
       FROM (SELECT DISTINCT gene FROM transcripts_v) AS q) AS c ON c.gene = t.gene""", "transcripts_v"))
def clustered_layout(spark, sf):
    raw = a.transcripts(spark, sf)
    laid = sampling.clustered_layout(raw, t.marker_group(raw))
    return laid.select("gene", "x", "y", "background", "marker_group", "gene_code")


@query(oracle("SELECT DISTINCT gene FROM transcripts_v WHERE lower(gene) NOT LIKE '%blank%'", "transcripts_v"))
def enabled_genes(spark, sf):
    return t.enabled_genes(a.transcripts(spark, sf))


@query(oracle(f"""
    SELECT o.gene, c.fg, c.bg, o.marker_group, fg_start, fg_end, bg_end, lower(o.gene) LIKE '%blank%' AS is_control
    FROM ({_OFFSETS}) AS o JOIN gene_fg_bg_v AS c ON c.gene = o.gene""", "gene_fg_bg_v", "annotated_genes_v", groups_v=_BY_BROAD))
def gene_panel(spark, sf):
    """Flagship: the gene panel with counts, marker groups and offsets."""
    counts = materialize(t.gene_fg_bg_counts(a.transcripts(spark, sf)))
    groups = p.marker_group_by_broad(p.annotate_genes(counts.select("gene"), a.marker_reference(spark, sf)))
    return t.gene_panel(counts, groups)


_KEY_TEXT = """CASE s_suppkey % 12 WHEN 0 THEN CAST(s_suppkey AS VARCHAR(20)) || '.0' WHEN 1 THEN '  ' || CAST(s_suppkey AS VARCHAR(20)) || ' '
    WHEN 2 THEN '00' || CAST(s_suppkey AS VARCHAR(20)) WHEN 3 THEN CAST(s_suppkey AS VARCHAR(20)) || 'e2' WHEN 4 THEN 'cell ' || CAST(s_suppkey AS VARCHAR(20))
    WHEN 5 THEN CAST(NULL AS VARCHAR(20)) WHEN 6 THEN 'NaN' WHEN 7 THEN '-inf' WHEN 8 THEN CAST(s_suppkey AS VARCHAR(20)) || '.5'
    WHEN 9 THEN '1_' || CAST(s_suppkey AS VARCHAR(20)) WHEN 10 THEN CAST(s_suppkey AS VARCHAR(20)) || 'd' ELSE '9223372036854775' || CAST(s_suppkey AS VARCHAR(20)) END"""


@query(f"""
    SELECT s_suppkey, {_KEY_TEXT} AS raw,
      CASE s_suppkey % 12 WHEN 3 THEN CAST(s_suppkey * 100 AS VARCHAR) WHEN 4 THEN 'cell ' || s_suppkey WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN ''
        WHEN 8 THEN s_suppkey || '.5' WHEN 9 THEN '1' || s_suppkey WHEN 10 THEN s_suppkey || 'd' WHEN 11 THEN '9223372036854775' || s_suppkey
        ELSE CAST(s_suppkey AS VARCHAR) END AS cell_key
    FROM supplier""", name="normalize_cell_key")
def normalize_cell_keys(spark, sf):
    raw = a.table(spark, sf, "supplier").select("s_suppkey", F.expr(_KEY_TEXT.replace("VARCHAR(20)", "STRING")).alias("raw"))
    return raw.withColumn("cell_key", normalize_cell_key("raw"))
