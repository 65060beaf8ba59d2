"""Boundaries from GeoJSON and cells that follow them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroseries.operators import boundary as BO, geo as G
from agroseries.sources import readers as R

HOLED = [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]


def brute(px, py, edges):
    return sum((y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges) % 2 == 1


def edge_rows(edges):
    return [(r.x1, r.y1, r.x2, r.y2) for r in edges.collect()]


def test_edges_of_parts_and_holes(spark, tmp_path):
    far = [[[20, 0], [22, 0], [21, 2]]]  # an open ring
    feature = lambda code, kind, coords: {"type": "Feature", "properties": {"codarea": code}, "geometry": {"type": kind, "coordinates": coords}}
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [
        feature("41", "MultiPolygon", [HOLED, far]), feature("42", "Polygon", HOLED), feature("43", "Point", [1, 2]), feature("44", "MultiPolygon", []), feature("45", "Polygon", [[]])]}))
    edges = BO.geometry_edges(R.read_boundaries(spark, str(p))).cache()
    got = {tuple(r) for r in edges.groupBy("code", "part", "ring").count().collect()}
    assert got == {(41, 0, 0, 4), (41, 0, 1, 4), (41, 1, 0, 3), (42, 0, 0, 4), (42, 0, 1, 4)}
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (4.0, 5.0), (21.0, 1.0), (0.0, 3.0), (30.0, 1.0), (None, 1.0), (float("nan"), 1.0), (15.0, 5.0)], "x double, y double")
    own = {(r.x, r.y): (r.inside, r.on_border) for r in BO.inside(pts, edges.where("code = 41")).collect() if r.x is not None}
    assert own[1.0, 1.0] == (True, False) and own[5.0, 5.0] == (False, False) and own[4.0, 5.0][1] and own[21.0, 1.0][0] and own[0.0, 3.0][1]
    assert own[30.0, 1.0] == own[15.0, 5.0] == (False, False) and BO.inside(pts, edges.where("code = 41")).count() == 9
    assert {(r.x, r.boundary) for r in BO.locate(pts, edges).collect()} == {(1.0, 41), (1.0, 42), (4.0, 41), (4.0, 42), (21.0, 41), (0.0, 41), (0.0, 42)}
    assert {(r.x, r.boundary) for r in BO.locate(pts, edges, border=False).collect()} == {(1.0, 41), (1.0, 42), (21.0, 41)}
    assert BO.locate(pts, edges.limit(0)).count() == 0 and not any(r.inside for r in BO.inside(pts, edges.limit(0)).collect())
    clash = pts.where("x IS NOT NULL").selectExpr("x AS code", "y AS base", "1 AS level", "x AS edges")
    assert BO.inside(clash, edges.where("code = 41"), "code", "base").where("inside").count() == 3  # with (4, 5) or (0, 3) as the rule has it
    assert BO.inside(clash, edges.where("code = 41"), "code", "base").columns == [*clash.columns, "inside", "on_border"]


@pytest.mark.parametrize("most", [2, 32])
def test_cells_match_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(BO.boundary_cells, "__defaults__", (most,))
    rng = np.random.default_rng(3)
    ang = np.sort(rng.random(40) * 2 * np.pi)
    rad = 1 + rng.random(40) * 2
    ring = [[float(r * np.cos(a)), float(r * np.sin(a))] for a, r in zip(ang, rad)]
    hole = [[0.3 * x, 0.3 * y] for x, y in ring]
    rows = spark.createDataFrame([("a", "Polygon", json.dumps([ring, hole]))], "code string, geom_type string, coords string")
    edges = BO.geometry_edges(rows).cache()
    pts = [(float(x), float(y)) for x, y in rng.uniform(-3.5, 3.5, size=(1500, 2))] + [tuple(p) for p in ring]
    got = {(r.x, r.y): (r.inside, r.on_border) for r in BO.inside(spark.createDataFrame(pts, "x double, y double"), edges).collect()}
    flat = edge_rows(edges)
    assert all(got[p][0] == brute(*p, flat) for p in pts[:1500])
    assert all(got[p][1] for p in pts[1500:])
    grid = [(float(i), float(j)) for i in range(-3, 4) for j in range(-3, 4)]
    lattice = [[float(x), float(y)] for x, y in [(-3, -3), (3, -3), (3, 3), (1, 3), (1, -1), (-1, -1), (-1, 3), (-3, 3)]]
    square = BO.geometry_edges(spark.createDataFrame([("b", "Polygon", json.dumps([lattice]))], rows.schema))
    own = {(r.x, r.y): (r.inside and not r.on_border) for r in BO.inside(spark.createDataFrame(grid, "x double, y double"), square).collect()}
    assert {p for p, v in own.items() if v} == {(x, y) for x, y in grid if -3 < x < 3 and -3 < y < 3 and not (-1 <= x <= 1 and y >= -1)}


def test_a_fine_boundary_has_small_cells(spark):
    n = 100_000
    t = spark.range(n).select("id", (F.col("id") * (2 * math.pi / n)).alias("a"))
    r = 3 + F.sin(7 * F.col("a")) + 0.05 * F.sin(901 * F.col("a"))
    at = lambda a: (r_of(a) * F.cos(a), r_of(a) * F.sin(a))
    r_of = lambda a: 3 + F.sin(7 * a) + 0.05 * F.sin(901 * a)
    nxt = ((F.col("id") + 1) % n) * (2 * math.pi / n)
    (x1, y1), (x2, y2) = at(F.col("id") * (2 * math.pi / n)), at(nxt)
    edges = t.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(0).alias("code"))
    cells = BO.boundary_cells(edges)
    sizes = cells.leaves.select(F.coalesce(F.size("edges"), F.lit(0)).alias("n"), "base").cache()
    assert sizes.agg(F.max("n")).first()[0] <= BO.EDGES
    # edges that lie in several cells are few, and whole cells have none
    assert sizes.agg(F.sum("n")).first()[0] < 2 * n and sizes.where("n = 0 AND base = 1").count() > 100
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-4.2, 4.2, size=(3000, 2))]
    got = {(p.x, p.y): p.inside for p in BO.inside(spark.createDataFrame(pts, "x double, y double"), edges).collect()}
    radius = lambda a: 3 + math.sin(7 * a) + 0.05 * math.sin(901 * a)
    for x, y in pts:
        gap = math.hypot(x, y) - radius(math.atan2(y, x) % (2 * math.pi))
        assert abs(gap) < 1e-3 or got[x, y] == (gap < 0)


def test_clip_and_mask_use_the_cells(spark):
    edges = BO.geometry_edges(spark.createDataFrame([("a", "Polygon", json.dumps(HOLED))], "code string, geom_type string, coords string"))
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (4.0, 5.0), (0.0, 3.0)], "lon double, lat double")
    assert {tuple(r) for r in G.clip_points(pts, edges).collect()} == {(1.0, 1.0), (4.0, 5.0), (0.0, 3.0)}
    masked = G.mask_grid(pts.toDF("x", "y"), edges)
    assert {(r.x, r.y) for r in masked.where("inside").collect()} == {(1.0, 1.0)} and masked.columns == ["x", "y", "inside"]
