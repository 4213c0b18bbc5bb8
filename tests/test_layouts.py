"""Layouts and stored versions: what a reader opens, and what it sees."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import cells as c
from cytoplane.operators import layout
from cytoplane.operators import raster as r
from cytoplane.operators import tiles
from cytoplane.operators import transcripts as t
from cytoplane.operators.grid import split_hot
from cytoplane.sources import cells as stored
from cytoplane.sources import tables
from cytoplane.sources.cells import scan_cells
from cytoplane.streaming import counts as st
from cytoplane.streaming.versions import Versions, read_versions, write_versions

VERTEX = "array<struct<x:double,y:double>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hilbert_keys_walk_to_neighbours(spark):
    side = 16
    keys = {q.d: (q.x, q.y) for q in spark.range(side * side).select((F.col("id") % side).alias("x"), (F.col("id") / side).cast("long").alias("y")).select(
        "x", "y", layout.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(keys) == list(range(side * side))
    assert all(abs(keys[k][0] - keys[k + 1][0]) + abs(keys[k][1] - keys[k + 1][1]) == 1 for k in range(side * side - 1))


def squares(spark, n):
    """n x n cells on a grid, in an order that has nothing to do with their place."""
    ids = spark.range(n * n).repartition(4).select(
        F.lit("s").alias("section"), F.col("id").cast("string").alias("cell_id"), F.col("id").alias("shape_ord"),
        (F.pmod(F.xxhash64("id"), F.lit(n * n))).alias("_"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"))
    ring = F.expr("array(named_struct('x', x, 'y', y), named_struct('x', x + 0.8D, 'y', y), named_struct('x', x + 0.8D, 'y', y + 0.8D), named_struct('x', x, 'y', y + 0.8D))")
    parts = F.array(F.struct(ring.alias("exterior"), F.array().cast(f"array<{VERTEX}>").alias("holes")))
    return scan_cells(ids.withColumn("parts", parts))


def test_a_small_box_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "cells")
    layout.write_cells(squares(spark, 100), path, 1 << 16)
    groups = [m.row_group(k) for f in sorted((tmp_path / "cells").glob("*.parquet")) for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]

    def bounds(group):
        told = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        return told["xmin"].min, told["xmax"].max, told["ymin"].min, told["ymax"].max

    box = (20.0, 20.0, 25.0, 25.0)
    met = [b for b in map(bounds, groups) if b[0] <= box[2] and b[1] >= box[0] and b[2] <= box[3] and b[3] >= box[1]]
    assert len(groups) >= 16 and len(met) <= len(groups) / 4
    assert c.cells_in_bbox(spark.read.parquet(path), *box).count() == 36


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(20_000).select(
        F.lit("s").alias("section"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("gene"), (F.col("id") % 100).cast("double").alias("x"),
        F.floor(F.col("id") / 100).cast("double").alias("y"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 400).alias("assignment"))


def test_a_look_up_opens_one_or_two_files(spark, points, tmp_path):
    path = str(tmp_path / "index")
    layout.write_cell_index(points, path, files=8)
    assert len(spark.read.parquet(f"{path}/points").inputFiles()) >= 4
    one = layout.look_up_cells(spark, path, [{"section": "s", "cell_id": "17"}])
    assert 1 <= len(one.inputFiles()) <= 2
    want = t.transcripts_for_cells(points, spark.createDataFrame([("s", "17")], "section string, cell_id string"))
    assert sorted(map(tuple, one.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # As a table, through the slices; a crowded cell, an unknown one and a repeated one.
    asked = spark.createDataFrame([("s", "17"), ("s", "17"), ("s", "5"), ("s", "no")], "section string, cell_id string")
    want = t.transcripts_for_cells(points, asked)
    assert sorted(map(tuple, layout.look_up_cells(spark, path, asked).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert layout.look_up_cells(spark, path, [{"section": "s", "cell_id": "zz"}]).count() == 0
    slices = {q.cell_id: q.n for q in spark.read.parquet(f"{path}/slices").groupBy("cell_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert slices == {q.cell_id: q.end - q.start for q in t.cell_slices(points).collect()}


def test_hot_groups_are_split(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 900, None).otherwise(F.col("id") % 2).alias("k"), "id")
    few = spark.createDataFrame([(None, "n"), (0, "a"), (1, "b")], "k long, name string")
    dealt, copied = split_hot(many, few, ["k"], F.xxhash64("id"), limit=100)
    sizes = [q["count"] for q in dealt.groupBy("k", "_salt").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 1000
    assert copied.groupBy("name").count().filter("name = 'n'").first()["count"] == 9


def test_hot_groups_are_dealt_by_a_hash_unless_it_is_uneven(spark):
    few = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    plain = spark.range(1000).selectExpr("id div 900 AS k", "id")
    dealt, _ = split_hot(plain, few, ["k"], None, limit=100, guess=F.xxhash64("id"))
    assert "_number" not in dealt._jdf.queryExecution().analyzed().toString()
    for rows in (plain, plain.withColumn("id", F.lit(7))):
        dealt, _ = split_hot(rows, few, ["k"], None, limit=100, guess=F.xxhash64("id"))
        sizes = [q["count"] for q in dealt.groupBy("k", "_salt").count().collect()]
        assert max(sizes) < 300 and sum(sizes) == 1000


def test_crowded_cells_and_points_give_the_same(spark, points, monkeypatch):
    from cytoplane.operators import grid

    cells = squares(spark, 20).unionByName(squares(spark, 5).withColumn("cell_id", F.concat(F.lit("b"), "cell_id")).withColumn("shape_ord", F.col("shape_ord") + 1000))
    at = points.select("section", (F.col("x") / 5).alias("x"), (F.col("y") / 10).alias("y"))
    plain = sorted(map(tuple, c.locate_cell(at, cells).collect()), key=str)
    image = tiles.pack_tiles(spark.range(400).selectExpr("'s' section", "'k' key", "'c' channel", "id div 20 row", "id % 20 col", "double(id) value", "20L height", "20L width"), "float64", 8)
    from cytoplane.functions import affine

    told = sorted(map(tuple, r.cell_channel_intensity(cells, image, 20, 20, affine.literal(), 8).collect()))
    monkeypatch.setattr(r, "CELLS", 3)
    monkeypatch.setattr(r, "CROWD", 1)
    assert sorted(map(tuple, r.cell_channel_intensity(cells, image, 20, 20, affine.literal(), 8).collect())) == told
    monkeypatch.setattr(grid.split_hot, "__defaults__", (50, None))
    assert sorted(map(tuple, c.locate_cell(at, cells).collect()), key=str) == plain


def test_segmentations_stay_apart(spark):
    from cytoplane.functions import affine

    both = squares(spark, 3).withColumn("seg_key", F.lit("a")).unionByName(
        squares(spark, 2).withColumns({"seg_key": F.lit("b"), "cell_id": F.concat(F.lit("b"), "cell_id")}))
    at = spark.createDataFrame([("s", 0.5, 0.5), ("s", 2.5, 2.5), ("t", 0.5, 0.5), ("s", None, 1.0)], "section string, x double, y double")
    got = {(q.section, q.x, q.seg_key): q.cell_id for q in c.locate_cell(at, both).collect()}
    assert got == {("s", 0.5, "a"): "0", ("s", 0.5, "b"): "b0", ("s", 2.5, "a"): "8", ("s", 2.5, "b"): None, ("t", 0.5, None): None,
                   ("s", None, "a"): None, ("s", None, "b"): None}
    drawn = r.raster_runs(both.withColumn("label_id", F.col("shape_ord") + 1), 30, 30, affine.literal(a=0.125, e=0.125), 16)
    area = {q.seg_key: q.n for q in drawn.groupBy("seg_key").agg(F.sum(F.col("col1") - F.col("col0") + 1).alias("n")).collect()}
    assert area == {"a": 9 * 49, "b": 4 * 49}
    shades = tiles.pack_tiles(spark.range(900).selectExpr("'s' section", "'k' key", "'c' channel", "id div 30 row", "id % 30 col", "1.0D value", "30L height", "30L width"), "float64", 16)
    n = {(q.seg_key, q.cell_id): q.n for q in r.cell_channel_intensity(both, shades, 30, 30, affine.literal(a=0.125, e=0.125), 16).collect()}
    assert len(n) == 13 and set(n.values()) == {49}


def test_sweep_against_painting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k = int(rng.integers(1, 9))
        first = rng.integers(0, 30, k)
        last = first + rng.integers(0, 12, k)
        rank = rng.permutation(k)
        canvas = np.full(50, -1)
        for run in np.argsort(rank):
            canvas[first[run]:last[run] + 1] = run
        swept = np.full(50, -1)
        for a, b, run in r.last_drawn(first.tolist(), last.tolist(), rank.tolist()):
            assert (swept[a:b + 1] == -1).all()
            swept[a:b + 1] = run
        assert (swept == canvas).all()


def test_run_sums_with_nan_and_infinity():
    data = np.array([[1.0, np.nan, 3.0, np.inf], [-np.inf, 2.0, np.nan, np.nan]])
    runs = np.array([(0, 0, 2), (0, 0, 3), (1, 0, 1), (1, 2, 3)])
    total, count = r.run_sums(data, runs)
    assert total.tolist() == [4.0, np.inf, -np.inf, 0.0] and count.tolist() == [2, 3, 2, 0]
    whole, n = r.run_sums(np.array([[200, 200, 200]], dtype=np.uint8), np.array([(0, 0, 2)]))
    assert whole.tolist() == [600.0] and n.tolist() == [3]


def test_distances_against_growth():
    rng = np.random.default_rng(4)
    mask = rng.random((25, 31)) < 0.02
    at = np.argwhere(mask)
    for reach in (0, 1, 4, 40):
        want = np.zeros_like(mask)
        for y, x in np.ndindex(mask.shape):
            want[y, x] = len(at) > 0 and np.abs(at - [y, x]).sum(axis=1).min() <= reach
        assert (tiles.within(mask, reach) == want).all()


@pytest.mark.parametrize("step,side", [(2, 8), (4, 16), (3, 9)])
@pytest.mark.parametrize("how", ["max", "mean"])
def test_pyramid_of_tiles_against_arrays(spark, step, side, how):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 1000, (53, 38))
    rows = [("s", "k", "c", i, [int(v) for v in line], 53, 38) for i, line in enumerate(data)]
    packed = tiles.tiles_from_rows(spark.createDataFrame(rows, "section string, key string, channel string, row long, values array<long>, height long, width long"), "int64", side)
    got = {}
    for q in tiles.unpack_tiles(tiles.tile_pyramid(packed, step, how, 4, 5, side), "bigint", side).collect():
        got.setdefault(q.level, {})[q.row, q.col] = q.value
    level = 0
    while max(data.shape) > 4 and min(data.shape) >= step and level < 5:
        data, level = tiles.shrink(data, step, how), level + 1
        assert got.pop(level) == {k: int(v) for k, v in np.ndenumerate(data)}
    assert not got


def test_a_level_is_read_alone(spark, tmp_path):
    base = tiles.tiles_from_rows(spark.createDataFrame([("s", "k", "c", i, [float(i)] * 32, 32, 32) for i in range(32)],
                                 "section string, key string, channel string, row long, values array<double>, height long, width long"), "float64", 16)
    coarse = tiles.tile_pyramid(base, 2, "mean", 4, 3, 16)
    named = {"scale10": coarse.filter("level = 2"), "scale2": coarse.filter("level = 1"), "scale0": base, "other": base}
    path = str(tmp_path / "image")
    stored.write_image_levels(named, path)
    assert [(q.scale, q.height, q.factor) for q in stored.image_levels(spark, path).orderBy("level").collect()] == [("scale0", 32, 1), ("scale2", 16, 2), ("scale10", 8, 4)]
    for factor, level in ((1, 0), (3.9, 1), (4, 2), (100, 2), (0.5, 0)):
        chosen = stored.scan_image_level(spark, path, "s", "k", factor)
        assert {q.level for q in chosen.select("level").collect()} == {level}
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    assert re.search(r"PartitionFilters: \[[^\]]*level#\d+ = 2\)", plan_of(stored.scan_image_level(spark, path, "s", "k", 100)))
    with pytest.raises(KeyError):
        stored.scan_image_level(spark, path, "s", "none")


def test_marker_reference_falls_back(spark):
    texts = spark.createDataFrame([("a", '{"G": ["x", "y"], "H": {"broad": "z"}}'), ("b", "no"), ("c", None)], "section string, text string")
    var = spark.createDataFrame([("a", "G", "from columns", None), ("b", "G", " T ", "nan"), ("b", "G", "T2", "f"), ("b", "K", "None", "f")],
                                "section string, gene string, broad_cell_type string, fine_cell_type string")
    got = sorted(tuple(q) for q in tables.resolve_marker_reference(texts, var).collect())
    assert got == [("a", "G", "x", "y"), ("a", "H", "z", ""), ("b", "G", "T2", "f")]


def test_versions_are_whole_and_bounded(spark, tmp_path):
    schema = "gene string, x double, y double, assignment long"
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    (tmp_path / "in").mkdir()
    stream = st.read_arriving(spark, source, spark.createDataFrame([], schema).schema, max_files=1)
    rows = []
    for k in range(7):
        more = [(f"g{i % 3}", float(i), 0.0, i % 4) for i in range(k, k + 9)]
        rows += more
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
        before = read_versions(spark, path) if k else None
        seen = before.count() if k else 0
        write_versions(st.stream_cell_gene_counts(stream), ["cell_id", "gene"], path, str(tmp_path / "cp"), merge_after=3).awaitTermination()
        if k:
            assert before.count() == seen  # a reader of the version before is not disturbed
        want = t.cell_gene_counts(spark.createDataFrame(rows, schema))
        assert sorted(map(tuple, read_versions(spark, path).collect())) == sorted(map(tuple, want.collect()))
    versions = Versions(spark, path)
    now = versions.current()
    assert now["version"] == 7 and now["base"] and len(now["deltas"]) < 3
    assert len(versions.numbers()) == 4
    # Changed totals only: a delta is smaller than the table.
    assert len(list((tmp_path / "table" / "base").iterdir())) <= 2


def test_an_empty_stream_has_a_table(spark, tmp_path):
    schema = "gene string, x double, y double, assignment long"
    (tmp_path / "in").mkdir()
    stream = st.read_arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    write_versions(st.stream_gene_counts(stream), ["gene"], str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert read_versions(spark, str(tmp_path / "t")).count() == 0
