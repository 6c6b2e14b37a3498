"""Planar geometry in WKT: bounds and distances, on the driver and as expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = re.compile(rf"({_NUMBER})\s+({_NUMBER})")
_KIND = re.compile(r"\s*(MULTI)?(POINT|POLYGON|LINESTRING)\s*\(", re.I)


def points(wkt: str) -> list[tuple[float, float]]:
    if not _KIND.match(wkt):
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    out = [(float(x), float(y)) for x, y in _PAIR.findall(wkt)]
    if not out:
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    return out


def bounds(wkt: str) -> tuple[float, float, float, float]:
    xs, ys = zip(*points(wkt), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _to_segment(x: float, y: float, a: tuple[float, float], b: tuple[float, float]) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / long)) if long else 0.0
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def _inside(x: float, y: float, ring: list[tuple[float, float]]) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def distance(wkt: str, x: float, y: float) -> float:
    """Least distance of a point to a geometry; 0 inside a polygon and outside its holes."""
    kind = _KIND.match(wkt)
    if not kind:
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    rings = [[(float(a), float(b)) for a, b in _PAIR.findall(part)] for part in re.findall(r"\(([^()]*)\)", wkt)]
    if kind[2].upper() == "POINT":
        return min(math.hypot(a - x, b - y) for ring in rings for a, b in ring)
    if kind[2].upper() == "POLYGON" and sum(_inside(x, y, r) for r in rings) % 2:
        return 0.0
    return min(_to_segment(x, y, a, b) for r in rings for a, b in zip(r, r[1:] or r, strict=False))


def _numbers(text: Column, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_PAIR.pattern), F.lit(group)), lambda v: v.cast("double"))


def is_geometry(column: Column) -> Column:
    return column.rlike(r"(?i)^\s*(MULTI)?(POINT|POLYGON|LINESTRING)\s*\(") & column.rlike(_PAIR.pattern)


def box_of(column: Column) -> Column:
    """The bounding box of WKT; null where it isn't WKT."""
    x, y = _numbers(column, 1), _numbers(column, 2)
    box = F.struct(F.array_min(x).alias("minx"), F.array_min(y).alias("miny"), F.array_max(x).alias("maxx"), F.array_max(y).alias("maxy"))
    point = rf"(?i)^\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)\s*$"
    px, py = (F.regexp_extract(column, point, i).try_cast("double") for i in (1, 2))
    one = F.struct(px.alias("minx"), py.alias("miny"), px.alias("maxx"), py.alias("maxy"))
    return F.when(column.rlike(point), one).when(is_geometry(column), box)


def distance_to(column: Column, x: float, y: float) -> Column:
    """distance() of each geometry from (x, y); null where it isn't WKT."""
    px, py = F.lit(float(x)), F.lit(float(y))
    rings = F.transform(F.regexp_extract_all(column, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda r: F.struct(_numbers(r, 1).alias("x"), _numbers(r, 2).alias("y")))
    near = lambda ax, ay: F.sqrt((ax - px) * (ax - px) + (ay - py) * (ay - py))

    def segment(r: Column, i: Column) -> Column:
        ax, ay = r["x"][i], r["y"][i]
        j = F.least(i + 1, F.size(r["x"]) - 1)
        dx, dy = r["x"][j] - ax, r["y"][j] - ay
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / long))).otherwise(0.0)
        return near(ax + t * dx, ay + t * dy)

    def crossings(r: Column) -> Column:
        n = F.size(r["x"])

        def crosses(i: Column) -> Column:
            j = F.pmod(i + 1, n)
            x0, y0, x1, y1 = r["x"][i], r["y"][i], r["x"][j], r["y"][j]
            return ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)

        return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))

    edges = lambda r: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(r["x"]) - 2, F.lit(0))), lambda i: segment(r, i)))
    filled = F.filter(rings, lambda r: F.size(r["x"]) > 0)
    inside = column.rlike(r"(?i)^\s*(MULTI)?POLYGON") & (F.pmod(F.aggregate(F.transform(filled, crossings), F.lit(0), lambda a, b: a + b), F.lit(2)) == 1)
    points = F.array_min(F.transform(filled, lambda r: F.array_min(F.zip_with(r["x"], r["y"], near))))
    kind = F.when(column.rlike(r"(?i)^\s*(MULTI)?POINT"), points).otherwise(F.array_min(F.transform(filled, edges)))
    return F.when(is_geometry(column), F.when(inside, 0.0).otherwise(kind))


def from_mapping(shape: dict) -> str:
    """WKT of a mapping with type and coordinates: a Point, or a Polygon by its outer ring."""
    kind, at = shape.get("type"), shape.get("coordinates")
    if kind == "Point":
        return f"POINT({at[0]} {at[1]})"
    if kind == "Polygon":
        return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in at[0]) + "))"
    raise ValueError(f"not a point or polygon: {kind!r}")
