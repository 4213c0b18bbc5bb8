"""Object annotations from GeoJSON, and GeoJSON files of both kinds of annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import geometry as g
from cytoplane.functions.text import strip
from cytoplane.operators.annotations import FILE_STEMS, bad_polygons, object_ids
from cytoplane.plans.registry import scratch
from cytoplane.session import materialize

OBJECT_SCHEMA = "distance_from_object/v1"
#: Messages that an error quotes; the table it names has all.
QUOTED = 20

_GEOMETRY = "struct<type:string,coordinates:string>"
_PROPERTIES = "struct<object_id:string,object_type:string,name:string>"
_FEATURE = f"struct<type:string,properties:{_PROPERTIES},geometry:{_GEOMETRY}>"
_DOCUMENT = (
    f"struct<type:string,features:array<{_FEATURE}>,properties:{_PROPERTIES},geometry:{_GEOMETRY},coordinates:string>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per GeoJSON file: ``(section, text)``, the section being the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("section"), F.col("value").alias("text"))


def scan_object_annotations(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons of GeoJSON documents ``(section, text)`` with their type and id, and the errors.

    A document is a FeatureCollection, a Feature or a bare geometry. Parts of a multipolygon get the
    feature's id with ``_1``, ``_2``, …; missing ids are generated. Holes, other geometries, invalid
    rings, repeated ids and documents without any object are errors.
    """
    parsed = documents.withColumn("_d", F.from_json("text", _DOCUMENT))
    d = F.col("_d")
    bare = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(None).cast(_PROPERTIES).alias("properties"),
        F.struct(d["type"].alias("type"), d["coordinates"].alias("coordinates")).alias("geometry"),
    )
    one = F.struct(d["type"].alias("type"), d["properties"].alias("properties"), d["geometry"].alias("geometry"))
    features = F.when(d["type"] == "FeatureCollection", d["features"]).when(
        d["type"] == "Feature", F.array(one.cast(_FEATURE))).otherwise(F.array(bare.cast(_FEATURE)))
    each = parsed.select("section", F.posexplode(features).alias("_i", "_f")).filter(F.col("_f.geometry").isNotNull())
    p, geometry = F.col("_f.properties"), F.col("_f.geometry")

    def present(name: str):
        return F.when(p[name] != "", p[name])

    polygon = F.array(F.from_json(geometry["coordinates"], "array<array<array<double>>>"))
    several = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    typed = each.select(
        "section",
        F.col("_i").cast("bigint").alias("feature"),
        strip(F.coalesce(present("object_type"), present("name"), F.lit("objects"))).alias("object_type"),
        F.coalesce(strip(p["object_id"]), F.lit("")).alias("_id"),
        geometry["type"].alias("_kind"),
        F.when(geometry["type"] == "Polygon", polygon).when(geometry["type"] == "MultiPolygon", several).alias("_parts"),
    )
    parts = typed.select("*", F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("_p", "_rings"))
    ring = "transform(get(_rings, 0), c -> named_struct('x', get(c, 0), 'y', get(c, 1)))"
    # Only a vertex that repeats the first one closes the ring; a ring that is left open keeps all its vertices.
    opened = g.let(ring, "rr", "CASE WHEN size(rr) > 1 AND get(rr, size(rr) - 1) = rr[0] THEN slice(rr, 1, size(rr) - 1) ELSE rr END")
    shapes = parts.select(
        "section",
        "feature",
        "object_type",
        F.when((F.col("_n") > 1) & (F.col("_id") != ""), F.concat("_id", F.lit("_"), (F.col("_p") + 1).cast("string")))
        .otherwise(F.col("_id")).alias("object_id"),
        F.coalesce("_p", F.lit(0)).cast("bigint").alias("part"),
        "_kind",
        (F.size("_rings") > 1).alias("_holes"),
        F.expr(g.drop_repeats(opened)).alias("vertices"),
    )
    rule = (
        F.when(~F.coalesce(F.col("_kind").isin("Polygon", "MultiPolygon"), F.lit(False)), F.lit("not_polygon"))
        .when(F.col("object_type") == "", F.lit("blank_type"))
        .when(F.col("_holes"), F.lit("holes"))
    )
    judged = shapes.withColumn("rule", rule)
    refused = judged.filter(F.col("rule").isNotNull()).select("section", "feature", "rule")
    plain = judged.filter(F.col("rule").isNull()).drop("rule", "_kind", "_holes")
    key = ["section", "object_type", "feature", "part"]
    bad = bad_polygons(plain, key).select("section", "feature", F.lit("invalid_geometry").alias("rule"))
    named = object_ids(plain, ("object_type", "feature", "part"))
    doubled = named.groupBy("section", "object_id").agg(F.count(F.lit(1)).alias("_n"), F.max("feature").alias("feature")).filter("_n > 1")
    none = documents.select("section").distinct().join(shapes.select("section"), "section", "left_anti")
    empty = none.select("section", F.lit(None).cast("bigint").alias("feature"), F.lit("no_objects").alias("rule"))
    doubled = doubled.select("section", "feature", F.lit("duplicate_id").alias("rule"))
    errors = refused.unionByName(bad).unionByName(doubled).unionByName(empty).distinct()
    return named.select("section", "object_type", "object_id", "feature", "part", "vertices"), errors


def read_object_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Objects of GeoJSON files; any error refuses the read."""
    objects, errors = scan_object_annotations(read_documents(spark, path))
    _refuse(errors, "rule", "object annotations are invalid")
    return objects


def _refuse(findings: DataFrame, column: str, text: str) -> None:
    """Raise if there are any findings. All of them are in the table that the error names; it quotes the first few."""
    spark = findings.sparkSession
    path = scratch(spark, "findings")
    findings.distinct().write.parquet(path)
    stored = spark.read.schema(findings.schema).parquet(path)
    total = stored.count()
    if total:
        told = stored.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column).limit(QUOTED).collect()
        quoted = "\n".join(f"{r[0]} ({r.n})" if r.n > 1 else str(r[0]) for r in told)
        raise ValueError(f"{text}: {total} findings, all of them in {path}\n{quoted}")


def _collections(features: DataFrame, groups: list[str], order: list[str], head: str, tails: DataFrame | None) -> DataFrame:
    """Lines of one FeatureCollection per group: an opening, one line per feature, a closing.

    A file is written by streaming its sorted lines, so a collection is never held as one value.
    """
    features = materialize(features)
    keys = features.select(*groups).distinct()
    body = features.select(*groups, F.lit(1).alias("_k"), *order, F.col("feature").alias("value"))
    # Every line but the group's first starts with the comma that separates it from the one before.
    first = features.groupBy(*groups).agg(F.min(F.struct(*order)).alias("_first"))
    body = body.join(first, groups).withColumn(
        "value", F.when(F.struct(*order) == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value"))
    ).drop("_first")
    blank = [F.lit(None).cast(dict(body.dtypes)[c]).alias(c) for c in order]
    opening = keys.select(*groups, F.lit(0).alias("_k"), *blank, F.lit(head).alias("value"))
    if tails is None:
        closing = keys.select(*groups, F.lit(2).alias("_k"), *blank, F.lit("]}").alias("value"))
    else:
        closing = keys.join(tails, groups, "left").select(
            *groups, F.lit(2).alias("_k"), *blank, F.concat(F.lit("]"), F.coalesce("tail", F.lit("")), F.lit("}")).alias("value"))
    lines = opening.unionByName(body).unionByName(closing)
    # A partition column that may be null makes the writer sort again, by that column only, which
    # would drop the order of the lines. Without nulls it accepts the order it is given.
    fixed = lines.select(*[F.coalesce(c, F.lit("")).alias(c) for c in groups], "_k", *order, "value")
    return fixed.repartition(*groups).sortWithinPartitions(*groups, "_k", *order).select(*groups, "value")


_HEAD = '{"type":"FeatureCollection","features":['


def write_annotations(
    features: DataFrame,
    findings: DataFrame,
    path: str,
    allow_invalid: bool = False,
    include_validation_report: bool = False,
) -> None:
    """One combined FeatureCollection per section; refused when there are errors, unless forced."""
    errors = findings.filter("severity = 'error'")
    if not allow_invalid:
        _refuse(errors, "message", "annotations are invalid")
    tails = None
    if include_validation_report:
        def told(severity: str):
            return F.sort_array(F.collect_set(F.when(F.col("severity") == severity, F.col("message"))))

        report = findings.groupBy("section").agg(told("error").alias("errors"), told("warning").alias("warnings"))
        sections = features.select("section").distinct().join(report, "section", "left")
        none = F.array().cast("array<string>")
        e, w = F.coalesce("errors", none), F.coalesce("warnings", none)
        tails = sections.select("section", F.concat(F.lit(',"validation":'), F.to_json(F.struct(
            (F.size(e) == 0).alias("ok"), e.alias("errors"), w.alias("warnings")))).alias("tail"))
    lines = _collections(features, ["section"], ["ord_piece", "ord_role"], _HEAD, tails)
    lines.write.mode("overwrite").partitionBy("section").text(path)


def write_annotations_by_role(features: DataFrame, findings: DataFrame, path: str, allow_invalid: bool = False) -> None:
    """One FeatureCollection per section and role, under the role's fixed file stem; refused as the combined one is."""
    if not allow_invalid:
        _refuse(findings.filter("severity = 'error'"), "message", "annotations are invalid")
    stems = F.create_map(*[F.lit(v) for pair in FILE_STEMS.items() for v in pair])
    named = features.withColumn("stem", stems[F.col("role")])
    lines = _collections(named, ["section", "stem"], ["ord_piece", "ord_role"], _HEAD, None)
    lines.write.mode("overwrite").partitionBy("section", "stem").text(path)


def write_objects(features: DataFrame, findings: DataFrame, path: str, schema: str = OBJECT_SCHEMA) -> None:
    """One object FeatureCollection per section, with its schema tag; refused when there are errors."""
    _refuse(findings.filter("severity = 'error'"), "message", "object annotations are invalid")
    head = f'{{"type":"FeatureCollection","object_annotation_schema":"{schema}","features":['
    lines = _collections(features, ["section"], ["object_type", "shape_ord"], head, None)
    lines.write.mode("overwrite").partitionBy("section").text(path)
