"""Planar searches over WKT columns: bounding boxes prune, exact distances refine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.wkt import box_of, distance_to


def with_box(df: DataFrame, geometry: str, name: str = "_box") -> DataFrame:
    return df.withColumn(name, box_of(F.col(geometry)))


def meets(box: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return (box["minx"] <= x1) & (box["maxx"] >= x0) & (box["miny"] <= y1) & (box["maxy"] >= y0)


def box_distance(box: Column, x: float, y: float) -> Column:
    dx = F.greatest(box["minx"] - x, F.lit(0.0), F.lit(x) - box["maxx"])
    dy = F.greatest(box["miny"] - y, F.lit(0.0), F.lit(y) - box["maxy"])
    return F.sqrt(dx * dx + dy * dy)


def _is_point(box: Column) -> Column:
    return (box["minx"] == box["maxx"]) & (box["miny"] == box["maxy"])


def within(df: DataFrame, geometry: str, point: tuple[float, float], radius: float) -> DataFrame:
    """Rows at most radius away; only geometries whose box is near, and that aren't points, are parsed again."""
    x, y = point
    near = with_box(df, geometry).filter(meets(F.col("_box"), x - radius, y - radius, x + radius, y + radius))
    box = F.col("_box")
    exact = F.when(_is_point(box), box_distance(box, x, y)).otherwise(distance_to(F.when(~_is_point(box), F.col(geometry)), x, y))
    return near.filter(exact <= radius).drop("_box")


def intersects(df: DataFrame, geometry: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose bounding box meets the box, edges included."""
    return with_box(df, geometry).filter(meets(F.col("_box"), *box)).drop("_box")


def nearest(df: DataFrame, key: str, geometry: str, point: tuple[float, float], k: int = 1) -> DataFrame:
    """The k rows of least bounding-box distance, as _distance; ties by key."""
    out = with_box(df, geometry).filter(F.col("_box").isNotNull()).withColumn("_distance", box_distance(F.col("_box"), *point))
    return out.drop("_box").orderBy("_distance", key).limit(k)


def extent(df: DataFrame, geometry: str) -> DataFrame:
    """count and bounds of all geometries."""
    boxes = with_box(df, geometry).select("_box.*")
    return boxes.agg(F.count("minx").alias("geometries"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
