"""Distances and polygons on the sphere as native arithmetic."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.plans.values import PipelineError, Val, step

# Metres of the mean radius; the widest distance of $near; tolerances of borders (radians) and points (metres).
RADIUS = 6_371_000.0
WIDEST = 20_000_000.0
BORDER = 1e-7
SAME_POINT = 1.0
OPERATORS = {"$near", "$nearSphere", "$geoWithin", "$geoIntersects"}
MODIFIERS = {"$maxDistance", "$minDistance"}
#: Corners of a polygon that is compiled into one expression.
MOST_CORNERS = 512


def lon_lat(v: Val | None) -> tuple[Column, Column] | None:
    """Degrees of a GeoJSON point, a pair of numbers, or a document {lon|lng|longitude, lat|latitude}."""
    if v is None or v.is_null:
        return None
    if v.is_array:
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")
    if v.is_struct and "coordinates" in v.type.names:
        return lon_lat(step(v, "coordinates"))
    if v.is_struct:
        found = [next((v.col.getField(n).cast("double") for n in names if n in v.type.names), None) for names in (("lon", "lng", "longitude"), ("lat", "latitude"))]
        if None not in found:
            return found[0], found[1]
    return None


def point_of(x: Any) -> tuple[float, float]:
    """Degrees of a literal point."""
    if isinstance(x, dict) and "$geometry" in x:
        x = x["$geometry"]
    if isinstance(x, dict) and "coordinates" in x:
        x = x["coordinates"]
    elif isinstance(x, dict):
        x = [x.get("lon", x.get("lng", x.get("longitude"))), x.get("lat", x.get("latitude"))]
    if not isinstance(x, (list, tuple)) or len(x) != 2 or not all(isinstance(n, (int, float)) for n in x):
        raise PipelineError(f"not a point: {x!r}")
    return float(x[0]), float(x[1])


def haversine(lon: Column, lat: Column, at: tuple[float, float]) -> Column:
    """Metres between the columns' point and a literal one."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(lat - at[1]) + F.cos(F.radians(lat)) * math.cos(math.radians(at[1])) * half(lon - at[0])
    return 2 * RADIUS * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def box(lon: Column, lat: Column, at: tuple[float, float], metres: float) -> Column:
    """True for every point within that distance, and cheap: bounds of degrees that a scan's statistics can use."""
    d = math.degrees(metres / RADIUS) * (1 + 1e-9) + 1e-9
    out = lat.between(at[1] - d, at[1] + d)
    if abs(at[1]) + d < 89:
        w = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(d, 89.0))) / math.cos(math.radians(at[1])))))
        w += 1e-9
        if at[0] - w >= -180 and at[0] + w <= 180:
            out = out & lon.between(at[0] - w, at[0] + w)
    return out


def within_distance(v: Val | None, at: tuple[float, float], least: float, most: float) -> Column:
    place = lon_lat(v)
    if place is None:
        return F.lit(False)
    d = haversine(*place, at)
    return F.coalesce(box(*place, at, most) & (d >= least) & (d <= most), F.lit(False))


def rings_of(geometry: dict[str, Any]) -> list[list[list[tuple[float, float]]]]:
    """Polygons as lists of closed rings, the first of each its border, the others holes."""
    kind, coordinates = geometry.get("type"), geometry.get("coordinates")
    polygons = {"Polygon": lambda: [coordinates], "MultiPolygon": lambda: coordinates}.get(kind)
    if polygons is None:
        raise PipelineError(f"no geometry of type {kind}")
    out = []
    for rings in polygons():
        made = []
        for ring in rings:
            points = [point_of(p) for p in ring]
            if len(points) < 4 or points[0] != points[-1]:
                raise PipelineError("a ring is closed and has four points at least")
            made.append(points)
        out.append(made)
    if sum(len(r) for p in out for r in p) > MOST_CORNERS:
        raise PipelineError(f"a geometry has {MOST_CORNERS} corners at most")
    return out


def _vector(p: tuple[float, float]) -> tuple[float, float, float]:
    lon, lat = map(math.radians, p)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> tuple[Column, Column]:
    """(the border winds around the point, the point is on the border); edges are arcs of great circles.

    Along an arc the direction from the point turns by less than half a circle, so the turns between corners sum to a
    full circle exactly for points inside.
    """
    x, y, z = F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))
    dot = lambda n: x * n[0] + y * n[1] + z * n[2]
    turn, border = F.lit(0.0), F.lit(False)
    for a, b in zip(ring, ring[1:]):
        if a == b:
            continue
        # The angle between the directions to two corners, by its tangent: p . (a x b) over (a . b - (p . a)(p . b)).
        va, vb = _vector(a), _vector(b)
        n = _cross(va, vb)
        flat = sum(i * j for i, j in zip(va, vb)) - dot(va) * dot(vb)
        turn = turn + F.atan2(dot(n), flat)
        size = math.sqrt(sum(i * i for i in n))
        if size:
            n = tuple(i / size for i in n)
            border = border | ((F.abs(dot(n)) <= BORDER) & (dot(_cross(n, va)) >= -BORDER) & (dot(_cross(vb, n)) >= -BORDER))
    # Around the antipodes of the inside the border winds too, but the other way.
    return turn * orientation(ring) > math.pi, border


def orientation(ring: list[tuple[float, float]]) -> int:
    """1 for a ring that runs against the clock as seen from outside, else -1: the sign of its area on the sphere."""
    corners = [_vector(p) for p in ring]
    middle = [sum(c[i] for c in corners[:-1]) for i in range(3)]
    size = math.sqrt(sum(i * i for i in middle)) or 1.0
    middle = [i / size for i in middle]
    dot = lambda a, b: sum(i * j for i, j in zip(a, b))
    area = sum(2 * math.atan2(dot(middle, _cross(a, b)), 1 + dot(a, b) + dot(b, middle) + dot(middle, a)) for a, b in zip(corners, corners[1:]))
    return 1 if area >= 0 else -1


def in_geometry(v: Val | None, geometry: dict[str, Any]) -> Column:
    place = lon_lat(v)
    if place is None:
        return F.lit(False)
    if geometry.get("type") == "Point":
        return within_distance(v, point_of(geometry), 0.0, SAME_POINT)
    out = F.lit(False)
    for rings in rings_of(geometry):
        around, border = in_ring(*place, rings[0])
        own = around | border
        for hole in rings[1:]:
            inside, rim = in_ring(*place, hole)
            own = own & (~inside | rim)
        out = out | own
    return F.coalesce(out, F.lit(False))


def predicate(v: Val | None, cond: dict[str, Any], root: Any = None, path: str = "") -> Column:
    out = F.lit(True)
    for op in OPERATORS & set(cond):
        x = cond[op]
        if op in ("$near", "$nearSphere"):
            inner = x if isinstance(x, dict) else {}
            least, most = (inner.get(k, cond.get(k, d)) for k, d in (("$minDistance", 0.0), ("$maxDistance", WIDEST)))
            out = out & within_distance(v, point_of(x), float(least), float(most))
        elif "$centerSphere" in x:
            at, radians = x["$centerSphere"]
            out = out & within_distance(v, point_of(at), 0.0, float(radians) * RADIUS)
        elif "$geometry" in x:
            out = out & in_geometry(v, x["$geometry"])
        else:
            raise PipelineError(f"{op} takes $geometry or $centerSphere")
    return out


def near_of(query: dict[str, Any]) -> tuple[str, tuple[float, float]] | None:
    """The path and point of a top-level $near, by which find sorts."""
    for path, cond in query.items():
        if isinstance(cond, dict):
            for op in ("$near", "$nearSphere"):
                if op in cond:
                    return path, point_of(cond[op])
    return None


POINT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
