"""Geospatial operators.

* G1  vertex-mean centroid of GeoJSON Point / Polygon / MultiPolygon, parsed
      with ``from_json`` per geometry type and reduced with ``aggregate``.
* G2/G4 even-odd point-in-polygon over cells that follow the boundary
      (``operators/boundary.py``); an explicit on-segment test makes the border rule
      selectable (``clip`` keeps border points, ``contains`` drops them).  A plain
      band join over y (``point_in_polygon``) is kept for boundaries of few edges.
* G3  regular grid from ``spark.range`` with integer steps (x = x0 + i·step, as
      ``arange``), so no floating accumulation and no driver-side list.
* G5  inverse-distance surfaces over the grid: stations in blocks, each cell meets each
      block once and the blocks' sums add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_STEP = 0.02
STATION_BLOCK = 2_000
STATION_PARTS = 8
MIN_STATIONS = 3  # strictly more valid coordinates are required

POINT_T = "array<double>"
POLYGON_T = "array<array<array<double>>>"
MULTI_T = "array<array<array<array<double>>>>"


# --- G1 -------------------------------------------------------------------------------
def _mean_of(points: Column, i: int) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[i])
    return total / F.size(points)


def centroid(geom_type, coords_json) -> Column:
    """struct(lat, lon), 6 decimals; outer rings only; closing vertex counted."""
    t = geom_type if isinstance(geom_type, Column) else F.col(geom_type)
    js = coords_json if isinstance(coords_json, Column) else F.col(coords_json)
    pt = F.from_json(js, POINT_T)
    poly_ring = F.from_json(js, POLYGON_T)[0]
    multi_pts = F.flatten(F.transform(F.from_json(js, MULTI_T), lambda poly: poly[0]))
    lat = (F.when(t == "Point", pt[1])
            .when(t == "Polygon", _mean_of(poly_ring, 1))
            .when(t == "MultiPolygon", _mean_of(multi_pts, 1)))
    lon = (F.when(t == "Point", pt[0])
            .when(t == "Polygon", _mean_of(poly_ring, 0))
            .when(t == "MultiPolygon", _mean_of(multi_pts, 0)))
    return F.struct(F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"))


# --- F7 -------------------------------------------------------------------------------
def valid_coords(df: DataFrame, lat: str = "lat", lon: str = "lon",
                 minimum: int = MIN_STATIONS) -> DataFrame:
    """rows with both coordinates; raises unless more than ``minimum`` remain."""
    out = df.dropna(subset=[lat, lon])
    n = out.limit(minimum + 1).count()
    if n <= minimum:
        raise ValueError(f"not enough valid coordinates ({n} <= {minimum})")
    return out


# --- polygon edges and the band join --------------------------------------------------
def ring_edges(rings: DataFrame, ring_id: str = "ring_id", seq: str = "seq",
               x: str = "x", y: str = "y") -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings given as ordered vertices."""
    w = Window.partitionBy(ring_id).orderBy(seq)
    v = rings.select(ring_id, seq, F.col(x).alias("x1"), F.col(y).alias("y1"),
                     F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    return v.filter(F.col("x2").isNotNull())


def _bands(edges: DataFrame, y0: float, band_h: float) -> DataFrame:
    lo = F.floor((F.least("y1", "y2") - F.lit(y0)) / band_h).cast("long")
    hi = F.floor((F.greatest("y1", "y2") - F.lit(y0)) / band_h).cast("long")
    return edges.withColumn("band", F.explode(F.sequence(lo, hi)))


def point_in_polygon(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y",
                     n_bands: int = 256) -> DataFrame:
    """Adds ``inside`` (even-odd rule) and ``on_border`` to every point.

    Edges of one boundary are banded on y and gathered per band; a point meets its
    band's edges once and folds over them in its row, wherever it is.  Spark chooses
    how to join from the measured sizes.  Points with no edge in their band are outside.
    """
    ext = edges.agg(F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1")).first()
    if ext["y0"] is None:
        return points.withColumn("inside", F.lit(False)).withColumn("on_border", F.lit(False))
    y0, y1 = float(ext["y0"]), float(ext["y1"])
    band_h = max((y1 - y0) / n_bands, 1e-12)
    eb = _bands(edges, y0, band_h).groupBy("band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    px, py = F.col(x), F.col(y)

    def crossing(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        return (straddles & (px < e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)))).cast("int")

    def on_segment(e):
        cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        return ((cross == 0) & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
                & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"])))

    band = F.floor((py - F.lit(y0)) / band_h).cast("long")
    j = points.withColumn("band", band).join(eb, "band", "left")
    n = F.aggregate("_edges", F.lit(0), lambda s, e: s + F.coalesce(crossing(e), F.lit(0)))
    return (j.withColumn("inside", F.coalesce(n % 2 == 1, F.lit(False)))
             .withColumn("on_border", F.coalesce(F.exists("_edges", on_segment), F.lit(False)))
             .drop("band", "_edges"))


def star_polygon(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """A closed ring through the given points ordered by angle around their mean.

    Returns vertices (ring_id, seq, x, y) with the first vertex repeated last.
    The point set is one boundary's vertices (bounded).
    """
    m = points.agg(F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    ang = F.atan2(F.col(y) - F.lit(float(m["my"])), F.col(x) - F.lit(float(m["mx"])))
    w = Window.orderBy(ang, F.col(x), F.col(y))
    v = points.select(F.col(x).alias("x"), F.col(y).alias("y"), ang.alias("_a")).withColumn(
        "seq", F.row_number().over(Window.orderBy("_a", "x", "y")) - 1)
    first = v.filter(F.col("seq") == 0).select("x", "y")
    n = v.count()
    closing = first.select(F.lit(n).alias("seq"), "x", "y")
    return (v.select("seq", "x", "y").unionByName(closing)
             .withColumn("ring_id", F.lit(0)))


def clip_points(points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points inside the boundary or on it (clip keeps the border)."""
    from .boundary import inside
    p = inside(points, edges, x, y)
    return p.filter(F.col("inside") | F.col("on_border")).drop("inside", "on_border")


def mask_grid(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """``inside`` = strictly inside (``contains`` excludes the border)."""
    from .boundary import inside
    p = inside(grid, edges, "x", "y")
    return p.withColumn("inside", F.col("inside") & ~F.col("on_border")).drop("on_border")


# --- G3 ---------------------------------------------------------------------------------
def arange_len(start: float, stop: float, step: float) -> int:
    return max(0, int(math.ceil((stop - start) / step)))


def make_grid(spark, bbox, step: float = GRID_STEP) -> DataFrame:
    """Cells x0 + i·step, y0 + j·step over [min, max) of the bbox (end exclusive)."""
    minx, miny, maxx, maxy = bbox
    nx, ny = arange_len(minx, maxx, step), arange_len(miny, maxy, step)
    r = spark.range(nx * ny)
    i = (F.col("id") % nx).cast("long")
    j = (F.col("id") / nx).cast("long")
    return r.select(i.alias("i"), j.alias("j"),
                    (F.lit(minx) + i.cast("double") * F.lit(step)).alias("x"),
                    (F.lit(miny) + j.cast("double") * F.lit(step)).alias("y"))


# --- G5 ---------------------------------------------------------------------------------
def idw_surface(grid: DataFrame, stations: DataFrame, power: float = 2.0, out: str = "z") -> DataFrame:
    """G5 (kernel ``idw``): Σ zᵢ/dᵢᵖ / Σ 1/dᵢᵖ; a cell on a station takes its value.

    ``stations`` (lon, lat, z) are dealt into blocks of at most ``STATION_BLOCK``; each
    cell meets each block once, reduces over it inside its row and the blocks' sums
    add up, so any number of stations is served and no pair table is made.
    """
    block = F.floor((F.row_number().over(Window.partitionBy("_part").orderBy("lon", "lat", "z")) - 1) / STATION_BLOCK)
    dealt = stations.where("lon IS NOT NULL AND lat IS NOT NULL AND z IS NOT NULL").withColumn("_part", F.pmod(F.xxhash64("lon", "lat"), F.lit(STATION_PARTS)))
    blocks = dealt.withColumn("_block", block).groupBy("_part", "_block").agg(
        F.sort_array(F.collect_list(F.struct(F.col("lon").alias("sx"), F.col("lat").alias("sy"), F.col("z").alias("sz")))).alias("_s"))
    cells = grid.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(STATION_PARTS - 1))))
    x, y = F.col("x"), F.col("y")

    def d2(s):
        return (x - s["sx"]) * (x - s["sx"]) + (y - s["sy"]) * (y - s["sy"])

    acc0 = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.lit(None).cast("double").alias("at"))
    tot = F.aggregate("_s", acc0, lambda acc, s: F.struct(
        (acc["num"] + F.when(d2(s) > 0, s["sz"] / F.pow(F.sqrt(d2(s)), power)).otherwise(0.0)).alias("num"),
        (acc["den"] + F.when(d2(s) > 0, 1.0 / F.pow(F.sqrt(d2(s)), power)).otherwise(0.0)).alias("den"),
        F.when(d2(s) == 0, F.coalesce(acc["at"], s["sz"])).otherwise(acc["at"]).alias("at")))
    met = cells.join(blocks, "_part").withColumn("_t", tot)
    z = F.coalesce(F.min("_t.at"), F.try_divide(F.sum("_t.num"), F.sum("_t.den")))
    return grid.join(met.groupBy("i", "j").agg(z.alias(out)), ["i", "j"], "left")
