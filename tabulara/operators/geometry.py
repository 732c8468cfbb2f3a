"""Polygons as nested arrays, with built-in expressions where they suffice: parts, bounds, area, validity of rings, snapping; dissolves by cancelling shared edges and line simplification in Arrow batches.

A geometry is MULTIPOLYGON as array<array<array<struct<x double, y double>>>>: polygons, rings (the first is the shell), points. Overlay of partly overlapping polygons is not offered: a dissolve joins polygons
that share whole edges, as the layers of one catalogue do, and keeps the others as parts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
GEOMETRY = f"array<array<array<{POINT}>>>"
#: Tolerances of simplification in degrees, by level; digits of the snapping and union grids.
TOLERANCE = {"regency": 0.0012, "province": 0.0025, "village": 0.0005, "district": 0.0007}
SNAP, GRID = 5, 7


def from_geojson(feature: Column) -> Column:
    """The polygons of a GeoJSON geometry (JSON text): Polygon and MultiPolygon; null for others, GeometryCollection too. A third coordinate is dropped."""
    kind = F.get_json_object(feature, "$.type")
    coords = F.get_json_object(feature, "$.coordinates")
    rings = lambda p: F.transform(p, lambda r: F.transform(r, lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))))
    one = F.array(rings(F.from_json(coords, "array<array<array<double>>>")))
    many = F.transform(F.from_json(coords, "array<array<array<array<double>>>>"), rings)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def bounds(g: Column) -> Column:
    points = F.flatten(F.flatten(g))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def ring_area(r: Column) -> Column:
    """Signed shoelace area."""
    pairs = F.zip_with(r, F.slice(r, 2, 1 << 30), lambda a, b: F.coalesce(a["x"] * b["y"] - b["x"] * a["y"], F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def area(g: Column) -> Column:
    """Shells less holes, of all parts."""
    part = lambda p: F.aggregate(p, F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("i")), lambda s, r: F.struct((s["a"] + F.when(s["i"] == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))).alias("a"), (s["i"] + 1).alias("i")))["a"]
    return F.aggregate(F.transform(g, part), F.lit(0.0), lambda s, v: s + v)


def is_sound(g: Column) -> Column:
    """Non-empty, finite, every ring closed and of four points at least, every shell with an area."""
    rings, points = F.flatten(g), F.flatten(F.flatten(g))
    finite = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)))
    return F.coalesce((F.size(g) > 0) & (F.size(points) > 0) & finite & closed & F.forall(g, lambda p: ring_area(p[0]) != 0), F.lit(False))


def snapped(g: Column, digits: int = SNAP) -> Column:
    """Points on a grid of 10^-digits; points that fall on their predecessor are dropped."""
    ring = lambda r: F.transform(r, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    thin = lambda r: F.aggregate(r, F.array().cast(f"array<{POINT}>"), lambda s, p: F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) == p), s).otherwise(F.array_append(s, p)))
    return F.transform(g, lambda poly: F.transform(poly, lambda r: thin(ring(r))))


def _simplified_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker without recursion on a closed ring; a ring that would lose its area keeps its points."""
    n = len(points)
    if n <= 5:
        return points
    keep = np.zeros(n, bool)
    far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    keep[[0, far, n - 1]] = True
    stack = [(0, far), (far, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*d)
        dist = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        m = int(dist.argmax())
        if dist[m] > tolerance:
            keep[a + 1 + m] = True
            stack += [(a, a + 1 + m), (a + 1 + m, b)]
    return points[keep] if keep.sum() >= 4 else points


def simplify(df: DataFrame, geometry: str, tolerance: float) -> DataFrame:
    """df with its geometry's rings simplified, point by point of a subset of the old ones."""

    @F.udf(GEOMETRY, useArrow=True)
    def thin(g):  # noqa: ANN001, ANN202
        if g is None:
            return None
        out = []
        for polygon in g:
            rings = [_simplified_ring(np.array([(p["x"], p["y"]) for p in ring]), tolerance) for ring in polygon]
            out.append([[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])
        return out

    return df.withColumn(geometry, thin(geometry))


def _rings_of(edges: set[tuple]) -> list[list[tuple]]:
    """Closed rings of directed edges, each edge used once."""
    following: dict[tuple, list[tuple]] = defaultdict(list)
    for a, b in sorted(edges):
        following[a].append(b)
    rings = []
    for start in sorted(following):
        while following[start]:
            ring, at = [start], start
            while following[at]:
                at = following[at].pop()
                ring.append(at)
                if at == start:
                    break
            if ring[0] == ring[-1] and len(ring) >= 4:
                rings.append(ring)
    return rings


def _area(ring: list[tuple]) -> float:
    a = np.array(ring)
    return float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum() / 2)


def _inside(point: tuple, ring: list[tuple]) -> bool:
    x, y = point
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def dissolve_polygons(polygons: list[list[list[tuple]]], digits: int = GRID) -> list[list[list[tuple]]]:
    """Polygons joined along whole shared edges: shells turn left and holes right, so an edge inside the union occurs in both directions and cancels."""
    edges: set[tuple] = set()
    for polygon in polygons:
        for i, ring in enumerate(polygon):
            pts = [(round(x, digits), round(y, digits)) for x, y in ring]
            if (_area(pts) < 0) == (i == 0):
                pts.reverse()
            for edge in zip(pts, pts[1:], strict=False):
                if edge[0] == edge[1]:
                    continue
                if edge[::-1] in edges:
                    edges.remove(edge[::-1])
                else:
                    edges.add(edge)
    shells, holes = [], []
    for ring in _rings_of(edges):
        (shells if _area(ring) > 0 else holes).append(ring)
    out = [[s] for s in sorted(shells, key=lambda s: -_area(s))]
    for hole in holes:
        home = [p for p in out if _inside(hole[0], p[0])] or out[:1]
        if home:
            home[-1].append(hole)
    return out


def dissolve(df: DataFrame, keys: list[str], geometry: str, complete: str | None = None) -> DataFrame:
    """One geometry per group, of all its parts. complete: name of a boolean column that must hold in every row of a group, else the group is left out (a parent is derived only from all its children).

    A group is one parent's children: its size is that of the hierarchy's fan-out.
    """
    if complete:
        whole = df.groupBy(*keys).agg(F.min(complete).alias("ok")).where("ok").drop("ok")
        df = df.join(whole, keys, "left_semi")

    def join(table: pa.Table) -> pa.Table:
        polygons = [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for g in table.column(geometry).to_pylist() if g for polygon in g]
        merged = [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in dissolve_polygons(polygons)]
        first = table.slice(0, 1).select(keys)
        return pa.table({**{k: first.column(k) for k in keys}, geometry: pa.array([merged], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", `{geometry}` {GEOMETRY}"
    return df.select(*keys, geometry).groupBy(*keys).applyInArrow(join, schema)


def feature_json(key: Column, name: Column, level: Column, source: Column, match: Column, g: Column) -> Column:
    """A GeoJSON feature as text."""
    coords = F.transform(g, lambda p: F.transform(p, lambda r: F.transform(r, lambda xy: F.array(xy["x"], xy["y"]))))
    geometry = F.when(F.size(g) == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(coords[0]), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(coords), F.lit("}")))
    properties = F.to_json(F.struct(key.alias("key"), name.alias("name"), level.alias("level"), source.alias("source"), match.alias("match")), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))


def collections(parents: DataFrame, features: DataFrame) -> DataFrame:
    """(parent_key, content): one FeatureCollection per parent, empty ones included. features: parent_key, key, feature."""
    per = features.groupBy("parent_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "feature"))), lambda x: x["feature"]), ",").alias("f"))
    joined = parents.select("parent_key").distinct().join(per, "parent_key", "left")
    return joined.select("parent_key", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce("f", F.lit("")), F.lit("]}\n")).alias("content"))


def clean(df: DataFrame, geometry: str, tolerance: float) -> DataFrame:
    """df with its geometry simplified and snapped, and `cleaned`: simplified, snapped (simplifying broke it), kept (so did snapping) or dropped (null: it was unsound as it came)."""
    raw, thin = F.col("_raw"), F.col(geometry)
    out = simplify(df.withColumn("_raw", F.col(geometry)), geometry, tolerance).withColumn(geometry, snapped(F.col(geometry))).withColumn("_snapped", snapped(raw))
    how = F.when(~is_sound(raw), "dropped").when(is_sound(thin), "simplified").when(is_sound(F.col("_snapped")), "snapped").otherwise("kept")
    out = out.withColumn("cleaned", how)
    kept = F.when(F.col("cleaned") == "simplified", thin).when(F.col("cleaned") == "snapped", F.col("_snapped")).when(F.col("cleaned") == "kept", raw)
    return out.withColumn(geometry, kept).drop("_raw", "_snapped")


def joined_parts(parts: DataFrame, key: str, source: str, match: str, geometry: str) -> DataFrame:
    """One row per key of its parts: the geometry of all of them, the sources joined by +, and the method, parts_union where there are several parts."""
    named = parts.where(F.col(geometry).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), "+").alias(source), F.when(F.count("*") > 1, "parts_union").otherwise(F.min(match)).alias(match))
    return dissolve(parts.where(F.col(geometry).isNotNull()), [key], geometry).join(named, key)


def derived_parents(children: DataFrame, every: DataFrame, geometry: str, source: str) -> DataFrame:
    """(parent_key, geometry, source, match): parents derived from children (parent_key, key, geometry), only where all their children in `every` (parent_key, key) have a geometry."""
    some = children.where(F.col(geometry).isNotNull()).select("parent_key", "key", geometry)
    met = every.select("parent_key", "key").distinct().join(some, ["parent_key", "key"], "left").withColumn("_whole", F.col(geometry).isNotNull())
    return dissolve(met, ["parent_key"], geometry, complete="_whole").select("parent_key", geometry, F.lit(source).alias("source"), F.lit("union").alias("match"))


def direct_first(direct: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """The direct rows, and of the derived ones those whose key has no direct one."""
    return direct.unionByName(derived.join(direct.select(key), key, "left_anti"))
