"""Expected values of small hand-made transcript tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoplane.functions.text import normalize_cell_key, safe_identifier
from cytoplane.operators import ordering, sampling
from cytoplane.operators import panel as p
from cytoplane.operators import transcripts as t
from cytoplane.sources.transcripts import resolve_columns, union_sections

POINTS = [
    ("AAA", False), ("AAA", False), ("AAA", True), ("BBB", False), ("BBB", False), ("Blank-1", False),
    ("CCC", False), ("CCC", True), ("CCC", True), ("CCC", True),
]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(g, float(i), float(i) * 2, bg, 0 if bg else 7) for i, (g, bg) in enumerate(POINTS)]
    return spark.createDataFrame(rows, "gene string, x double, y double, background boolean, assignment bigint").cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("source", ["background", "assignment"])
def test_panel_offsets(points, source):
    one = points.select("gene", "x", "y", source)
    counts = t.gene_fg_bg_counts(one)
    assert rows(counts, "gene") == [("AAA", 2, 1), ("BBB", 2, 0), ("Blank-1", 1, 0), ("CCC", 1, 3)]
    offsets = t.gene_offsets(counts, t.marker_group(one))
    assert rows(offsets, "gene") == [("AAA", 0, 0, 2, 3), ("BBB", 1, 0, 2, 2), ("Blank-1", 2, 0, 1, 1), ("CCC", 3, 0, 1, 4)]


def test_marker_groups_wrap(spark):
    data = [(f"G{i:03d}", 1.0, 1.0, i == 5 and k == 0) for i in range(20) for k in range(i + 1)]
    df = spark.createDataFrame(data, "gene string, x double, y double, background boolean")
    groups = t.marker_group(df)
    assert groups.select("marker_group").distinct().count() == 14
    offsets = {r.gene: r for r in t.gene_offsets(t.gene_fg_bg_counts(df), groups).collect()}
    assert all(offsets[f"G{i:03d}"].bg_end - offsets[f"G{i:03d}"].fg_start == i + 1 for i in range(20))
    assert offsets["G005"].bg_end - offsets["G005"].fg_end == 1
    assert offsets["G014"].fg_start == offsets["G000"].bg_end


def test_sample_keeps_source_counts(points):
    assert sampling.exact_sample(points, 5).count() == 5
    total = t.point_totals(points, 5).first()
    assert (total.source_total, total.rendered_total, total.sampled) == (10, 5, True)
    # The per-cell index is built from all points, whatever the sample.
    assert rows(t.cell_counts(points), "cell_id") == [("7", 6)]


def test_nothing_valid(spark):
    df = spark.createDataFrame([("AAA", float("nan"), 1.0)], "gene string, x double, y double")
    assert t.panel(df).count() == 0
    assert t.point_totals(df).first().source_total == 0


def test_cell_index(spark):
    data = [(float(i), float(i), g, c) for i, (g, c) in enumerate([("A", 202), ("B", 202), ("C", 101), ("D", 303), ("E", 0)])]
    df = spark.createDataFrame(data, "x double, y double, gene string, assignment bigint")
    asked = spark.createDataFrame([("202",), ("0",), ("999",)], "cell_id string")
    assert [r.gene for r in t.transcripts_for_cells(df, asked).orderBy("gene").collect()] == ["A", "B"]
    assert rows(t.cell_slices(df), "cell_id") == [("101", 0, 1), ("202", 1, 3), ("303", 3, 4)]


def test_ranked_genes(spark):
    df = spark.createDataFrame([("c", g, 1.0, 1.0, 1) for g in "AABCAB"], "cell string, gene string, x double, y double, assignment int")
    got = t.ranked_genes(t.cell_gene_counts(df)).orderBy("rank")
    assert [(r.gene, r.n) for r in got.collect()] == [("A", 3), ("B", 2), ("C", 1)]


@pytest.mark.parametrize("text, exact, parity", [
    ("5", "5", "5"), ("5.0", "5", "5"), (" cellA ", "cellA", "cellA"), (None, "", ""), ("NaN", "", ""), ("-inf", "", ""),
    ("1e3", "1000", "1000"), ("0.0", "0", "0"), ("007", "7", "7"), ("5d", "5d", "5d"), ("1_000", "1000", "1000"), ("2.5", "2.5", "2.5"),
    ("0.0005", "0.0005", "0.0005"), ("0.00001", "1e-05", "1e-05"), ("1.5e-7", "1.5e-07", "1.5e-07"), ("-0.0002", "-0.0002", "-0.0002"),
    ("3715213700018100006", "3715213700018100006", "3715213700018099712"), ("+3", "3", "3"), ("", "", ""),
])
def test_cell_keys(spark, text, exact, parity):
    df = spark.createDataFrame([(text,)], "v string")
    got = df.select(normalize_cell_key("v"), normalize_cell_key("v", exact=False)).first()
    want = str(int(float(parity))) if parity.isdigit() and len(parity) > 15 else parity
    assert got[0] == exact
    assert got[1] == (str(int(float(text))) if text and text.isdigit() and len(text) > 15 else want)


def test_cell_keys_of_numbers(spark):
    df = spark.createDataFrame([(5, 5.0, float("nan"))], "i int, d double, n double")
    assert tuple(df.select(*[normalize_cell_key(c) for c in "idn"]).first()) == ("5", "5", "")


def test_control_names(spark):
    names = ["Blank-10", "NegControlProbe_00042", "antisense-FOO", "APP", "GJA1", ""]
    df = spark.createDataFrame([(n,) for n in names], "gene string")
    flags = {r.gene: r.c for r in df.withColumn("c", t.is_control_gene("gene")).collect()}
    assert [flags[n] for n in names] == [True] * 3 + [False] * 3


def test_safe_identifier(spark):
    df = spark.createDataFrame([("Amyloid plaques",), ("__",), ("A/b-c.d ",)], "v string")
    assert [r[0] for r in df.select(safe_identifier("v")).collect()] == ["amyloid_plaques", "object", "a_b-c.d"]


def test_columns_by_name():
    found = resolve_columns(["global_x", "y_location", "target", "cell"])
    assert (found["x"], found["y"], found["gene"], found["assignment"]) == ("global_x", "y_location", "target", "cell")
    with pytest.raises(ValueError):
        resolve_columns(["gene", "x"])


def test_one_section_alone(points):
    assert union_sections({"XENIUM": points}).select("section").distinct().collect()[0][0] == "XENIUM"


def test_panel_groups(spark):
    genes = spark.createDataFrame([("G1",), ("G2",), ("Blank-1",), ("G3",)], "gene string")
    ref = spark.createDataFrame([("G1", "Neurons", "L2"), ("G3", "Astro", "")], "gene string, broad string, fine string")
    annotated = p.annotate_genes(genes, ref)
    order = [(r.title, r.gene) for r in p.panel_grouped(annotated, fine=True).collect()]
    control = p.CONTROL_GROUP
    assert order == [("Astro", None), ("Astro", "G3"), ("Neurons — L2", None), ("Neurons — L2", "G1"), (control, None), (control, "Blank-1"), (control, "G2")]
    assert p.has_reference_genes(genes, ref)
    assert not p.has_reference_genes(genes.filter("gene = 'G2'"), ref)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 320), seed=st.integers(0, 99), parts=st.integers(1, 6))
def test_sample_size_subset_and_seed(spark, n, seed, parts):
    df = spark.range(300).repartition(parts)
    got = {r.id for r in sampling.exact_sample(df, n, seed, ["id"]).collect()}
    again = {r.id for r in sampling.exact_sample(spark.range(300), n, seed, ["id"]).collect()}
    assert len(got) == min(n, 300) and got <= set(range(300)) and got == again


def test_sample_splits_copies(spark):
    """A third of all rows are copies of one row: the sample takes its share of them."""
    df = spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("v"))
    got = [r.v for r in sampling.exact_sample(df, 450, 1).collect()]
    assert len(got) == 450 and 100 < got.count(-1) < 200


def test_running_values_cross_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7 == 0).alias("g"), "id", F.lit(1).alias("one"), (F.col("id") * 37 % 101).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.s for r in ordering.running_in_group(df, ["g"], ["id"], "one", "s", inclusive=True).collect()}
        top = {r.id: r.m for r in ordering.running_in_group(df, ["g"], ["id"], "v", "m", how="max", inclusive=True).collect()}
        total = {r.id: r.t for r in ordering.running_total(df, ["id"], "v", "t").collect()}
        index = {r.id: r.i for r in ordering.global_index(df, ["id"], "i").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for flag in (True, False):
        ids = [i for i in range(1000) if (i % 7 == 0) == flag]
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
        best = 0
        for i in ids:
            best = max(best, i * 37 % 101)
            assert top[i] == best
    assert all(index[i] == i for i in range(1000))
    assert total[999] == sum(i * 37 % 101 for i in range(999))


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0, 10.0], list(map(float, range(100))), [5.0] * 50 + [1.0, 9.0]])
def test_percentiles_match_numpy(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ordering.exact_percentiles(df, [], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    assert np.allclose([got.a, got.b, got.c], np.percentile(values, [1, 50, 99]))
