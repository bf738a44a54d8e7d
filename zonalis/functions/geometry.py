"""Polygons as arrays of rings: WKT, boxes, tiles, point tests; all built-in functions.

A polygon table has ``id`` and ``rings``: arrays of ``struct<x, y>`` whose first and last
point are equal; holes and the parts of a multipolygon are rings like others, as the
even-odd rule treats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def rings(wkt: Column) -> Column:
    """The rings of a POLYGON or MULTIPOLYGON text; null for anything else."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.regexp_extract(F.trim(p), rf"^({NUMBER})", 1).try_cast("double").alias("x"), F.regexp_extract(F.trim(p), rf"^{NUMBER}\s+({NUMBER})", 1).try_cast("double").alias("y"))
    parsed = F.transform(texts, lambda r: F.transform(F.split(r, ","), point))
    return F.when(F.upper(F.trim(wkt)).rlike(r"^(MULTI)?POLYGON\s*\("), parsed)


def geojson(ring: Column) -> Column:
    """A polygon geometry of the rings, as JSON."""
    coords = F.transform(ring, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def box(polygons: DataFrame) -> DataFrame:
    """Adds ``min_x, min_y, max_x, max_y``."""
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    return polygons.withColumns({"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)})


def bounds(polygons: DataFrame) -> DataFrame:
    """One row: the box of all polygons and its centre."""
    b = box(polygons).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return b.withColumns({"center_x": (F.col("min_x") + F.col("max_x")) / 2, "center_y": (F.col("min_y") + F.col("max_y")) / 2})


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within, by the even-odd rule over all rings."""

    def crosses(p: Column, q: Column) -> Column:
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    edge = lambda r: F.size(F.filter(F.sequence(F.lit(1), F.size(r) - 1), lambda i: crosses(F.element_at(r, i), F.element_at(r, i + 1))))
    return F.aggregate(F.transform(F.filter(ring, lambda r: F.size(r) > 1), edge), F.lit(0), lambda a, n: a + n) % 2 == 1


def tiles(df: DataFrame, size: float) -> DataFrame:
    """A row for each tile that the box meets: ``tx, ty``."""
    grid = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return box(df).withColumn("tx", grid("min_x", "max_x")).withColumn("ty", grid("min_y", "max_y"))


def locate(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``points`` (``x, y``) and the first polygon by id that holds each, or null: an equi-join
    on tiles, then the exact test."""
    keyed = points.withColumn("_k", F.monotonically_increasing_id()).withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})
    hit = keyed.join(tiles(polygons, size), ["tx", "ty"]).where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & contains(F.col("rings"), F.col("x"), F.col("y")))
    plain = [c for c in points.columns]
    found = hit.groupBy(*plain).agg(F.min("id").alias("polygon"))
    on = points.alias("p").join(found.alias("f"), [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in plain], "left")
    return on.select("p.*", "f.polygon")


def touching(polygons: DataFrame, digits: int = 6) -> DataFrame:
    """``a, b``: polygons that share a corner, from both ends: an equi-join on corners, which
    finds all neighbours of a tessellation whose corners agree."""
    corner = polygons.select("id", F.explode(F.flatten("rings")).alias("p")).select("id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    return corner.toDF("a", "x", "y").join(corner.toDF("b", "x", "y"), ["x", "y"]).where("a <> b").select("a", "b").distinct()


def feature_collection(polygons: DataFrame, properties: list[str]) -> DataFrame:
    """One row ``collection``: GeoJSON of all polygons; meant for a zone, not for a country."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias("geometry"))
    rows = polygons.agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("k"), feature.alias("f")))).alias("rows"))
    return rows.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("rows", lambda r: r["f"]).alias("features"))).alias("collection"))
