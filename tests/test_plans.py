"""Properties of the plans themselves: what is pushed down, reused and never used."""

import re

import __spark_entry__ as entry
from cytoplane.operators import cells as c
from cytoplane.operators import celltypes as ct
from cytoplane.operators import raster as r
from cytoplane.plans import adapters as a
from cytoplane.sources.transcripts import scan_transcripts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stages_of(spark, name, action) -> int:
    """Stages that really ran for an action."""
    spark.sparkContext.setJobGroup(name, name)
    action()
    tracker = spark.sparkContext.statusTracker()
    done = set()
    for job in tracker.getJobIdsForGroup(name):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            if info is not None and info.numCompletedTasks > 0:
                done.add(stage)
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(done)


def test_scan_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).selectExpr("double(id) x", "double(id) y", "'g' gene", "id other").write.parquet(path)
    plan = plan_of(scan_transcripts(spark, path).select("gene"))
    assert re.search(r"ReadSchema: struct<gene:string>", plan)


def test_box_filter_reaches_the_scan(spark, tmp_path, tiny):
    path = str(tmp_path / "cells.parquet")
    a.cells(spark, tiny).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    plan = plan_of(c.cells_in_bbox(spark.read.parquet(path), 0, 0, 100, 100))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert all(f"({k}," in pushed for k in ("xmin", "xmax", "ymin", "ymax"))


def test_feature_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    values = spark.range(10).selectExpr("id label_id", "id % 3 column_index", "double(id) value")
    values.write.partitionBy("column_index").parquet(path)
    var = spark.createDataFrame([("f", "img", "a", "mean", 1)], "feature string, image_key string, channel string, statistic string, column_index bigint")
    chosen = ct.select_quantification(spark.read.parquet(path), var, "A", "MEAN")
    assert chosen.count() == 3 and "PartitionFilters: [isnotnull(column_index" in plan_of(chosen)


def test_pyramid_reads_its_base_once(spark, tmp_path):
    """Each level runs once: one stage per level and not one per pair of levels."""
    path = str(tmp_path / "p.parquet")
    spark.range(64 * 64).selectExpr(
        "'s' section", "'k' key", "'c' channel", "id div 64 row", "id % 64 col", "id value", "64L height", "64L width").write.parquet(path)
    pixels = spark.read.parquet(path)
    few = stages_of(spark, "few", lambda: r.mean_pyramid(pixels, 2, 2, 2).collect())
    many = stages_of(spark, "many", lambda: r.mean_pyramid(pixels, 2, 2, 5).collect())
    # Three more levels cost the same few stages each, whatever is below them.
    assert many - few <= 3 * 5


def test_no_cartesian_products(spark, tiny):
    for name in ("locate_cell", "tile_candidates", "boundary_crossings", "exclusion_contacts", "piece_overlaps", "value_overlay", "snap_to_edge"):
        plan = plan_of(entry.queries()[name](spark, tiny))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
