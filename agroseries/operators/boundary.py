"""Boundaries read from files, and cells that follow them.

``geometry_edges`` turns GeoJSON polygons (parts, holes) into an edge table.
``boundary_cells`` splits the boundary's box into cells until each holds at most
``EDGES`` edges: fine where the boundary is, coarse elsewhere.  A cell without edges is
inside or outside as a whole; a border cell has its few edges and the side of one
reference point on its right wall.  ``locate`` finds each point's cell by its number and
looks at that cell's edges only, so the work for a point does not grow with the boundary.

Sides are even-odd and go down the tree: a point's ray to the right is followed to the
wall of its cell, then along the wall to the reference point, whose side is known.
Every level is joins and grouped sums over edges; no cell gathers more than ``EDGES``
edges (but for those that meet in one point beyond ``MOST_LEVELS``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .geo import MULTI_T, POLYGON_T

EDGES = 32
FAN = 4  # a cell splits into FAN x FAN
MOST_LEVELS = 13  # FAN ** 13 cells on a side: 2 ** 26
MARGIN = 1e-6  # of a cell's side: edges this near count as touching it
# the box is larger than the boundary by odd shares, so that no wall meets round numbers
BEFORE, AFTER = 0.013719, 0.021343
REFERENCE = 0.480917  # where the reference point stands on the wall
CELL = ["level", "ix", "iy"]


def geometry_edges(boundaries: DataFrame, code: str = "code", geom_type: str = "geom_type", coords: str = "coords") -> DataFrame:
    """(code, part, ring, place, x1, y1, x2, y2) of Polygons and MultiPolygons given as
    JSON text; ring 0 of a part is its outline, others are holes.  An open ring is
    closed; other types, unreadable and empty geometry have no edges."""
    kind = F.col(geom_type)
    parts = F.when(kind == "Polygon", F.array(F.from_json(coords, POLYGON_T))).when(kind == "MultiPolygon", F.from_json(coords, MULTI_T))
    rings = boundaries.select(F.col(code).alias("code"), F.posexplode(parts).alias("part", "rings")).select("code", "part", F.posexplode("rings").alias("ring", "points"))
    closed = F.when(F.get("points", F.lit(0)) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    rings = rings.where(F.size("points") > 0).withColumn("points", closed)
    steps = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    edges = rings.select("code", "part", "ring", F.posexplode(steps).alias("place", "e"))
    return edges.select("code", "part", "ring", "place", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


class Cells(NamedTuple):
    """Leaves (code, level, ix, iy, base, edges) over a box at (x0, y0), w by h."""
    leaves: DataFrame
    levels: list[int]
    x0: float
    y0: float
    w: float
    h: float

    def right(self, level: Column, ix: Column) -> Column:
        return F.lit(self.x0) + (ix + 1) * (F.lit(self.w) / F.pow(F.lit(float(FAN)), level))

    def reference(self, level: Column, iy: Column) -> Column:
        return F.lit(self.y0) + (iy + F.lit(REFERENCE)) * (F.lit(self.h) / F.pow(F.lit(float(FAN)), level))


def _crossings(e, px: Column, py: Column, wall: Column, ry: Column) -> Column:
    """How often the edge meets the way right from (px, py) to the wall and on to (wall, ry)."""
    x_at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    across = ((e["y1"] > py) != (e["y2"] > py)) & (px < x_at) & (x_at < wall)
    y_at = e["y1"] + (wall - e["x1"]) * (e["y2"] - e["y1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))
    along = ((e["x1"] >= wall) != (e["x2"] >= wall)) & (y_at >= F.least(py, ry)) & (y_at < F.greatest(py, ry))
    return F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(along, F.lit(False)).cast("int")


def _on_segment(e, px: Column, py: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return ((cross == 0) & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
            & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"])))


def _touches(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    """Whether the edge x1..y2 meets the box (xa, ya, xb, yb), by separating lines."""
    c = F.col
    over = (F.least("x1", "x2") <= xb) & (F.greatest("x1", "x2") >= xa) & (F.least("y1", "y2") <= yb) & (F.greatest("y1", "y2") >= ya)
    side = lambda x, y: (c("x2") - c("x1")) * (y - c("y1")) - (c("y2") - c("y1")) * (x - c("x1"))
    corners = [side(x, y) for x in (xa, xb) for y in (ya, yb)]
    return over & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def boundary_cells(edges: DataFrame, most: int = EDGES) -> Cells | None:
    """Cells of one or several boundaries (column ``code``); None without edges."""
    ext = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    if ext[0] is None:
        return None
    ax, bx, ay, by = (float(v) for v in ext)
    sx, sy = max(bx - ax, 1e-9), max(by - ay, 1e-9)
    box = Cells(None, [], ax - BEFORE * sx, ay - BEFORE * sy, sx * (1 + BEFORE + AFTER), sy * (1 + BEFORE + AFTER))
    key = ["code", *CELL]
    at = cut_lineage(edges.select("code", *(F.lit(0).cast("long").alias(c) for c in CELL), "x1", "y1", "x2", "y2"))
    cells = cut_lineage(at.select(*key).distinct().withColumn("base", F.lit(0)))  # the root's reference stands outside
    leaves, levels, level = None, [], 0
    while True:
        n = at.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        known = cut_lineage(cells.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))))
        split = (F.col("n") > most) & F.lit(level < MOST_LEVELS)
        few = at.join(known.where(~split & (F.col("n") > 0)).select(*key), key, "left_semi")
        few = few.groupBy(*key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        own = cut_lineage(known.where(~split).drop("n").join(few, key, "left"))
        if own.limit(1).count():
            levels.append(level)
        leaves = own if leaves is None else leaves.union(own)
        open_cells = known.where(split).select(*key, "base")
        if not open_cells.limit(1).count():
            break
        kids = open_cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FAN * FAN - 1)))).withColumns(
            {"kx": F.col("ix") * FAN + F.col("k") % FAN, "ky": F.col("iy") * FAN + F.floor(F.col("k") / FAN)})
        met = at.join(kids, key)
        side_w, side_h = F.lit(box.w / FAN ** (level + 1)), F.lit(box.h / FAN ** (level + 1))
        xa, ya = F.lit(box.x0) + F.col("kx") * side_w, F.lit(box.y0) + F.col("ky") * side_h
        e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
        up = F.lit(level)
        way = _crossings(e, box.right(up + 1, F.col("kx")), box.reference(up + 1, F.col("ky")), box.right(up, F.col("ix")), box.reference(up, F.col("iy")))
        touching = _touches(xa - MARGIN * side_w, ya - MARGIN * side_h, xa + (1 + MARGIN) * side_w, ya + (1 + MARGIN) * side_h)
        renamed = ["code", F.lit(level + 1).cast("long").alias("level"), F.col("kx").alias("ix"), F.col("ky").alias("iy")]
        cells = cut_lineage(met.groupBy("code", "kx", "ky", "base").agg(F.sum(way).alias("n")).select(*renamed, ((F.col("base") + F.col("n")) % 2).cast("int").alias("base")))
        at = cut_lineage(met.where(touching).select(*renamed, "x1", "y1", "x2", "y2"))
        level += 1
    return box._replace(leaves=leaves, levels=levels)


def _placed(points: DataFrame, cells: Cells, x: str, y: str) -> DataFrame:
    """Every point of the box with its cell of each level that has leaves, one row each."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    spots = [F.struct(F.lit(n).cast("long").alias("level"), F.floor((px - cells.x0) / (cells.w / FAN ** n)).alias("ix"),
                      F.floor((py - cells.y0) / (cells.h / FAN ** n)).alias("iy")) for n in cells.levels]
    return points.withColumn("_at", F.explode(F.array(*spots))).withColumns({c: F.col(f"_at.{c}") for c in CELL}).drop("_at")


def _sided(met: DataFrame, cells: Cells, x: str, y: str) -> DataFrame:
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    wall, ry = cells.right(F.col("level"), F.col("ix")), cells.reference(F.col("level"), F.col("iy"))
    own = F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    way = F.aggregate(own, F.lit(0), lambda s, e: s + _crossings(e, px, py, wall, ry))
    return met.withColumn("inside", (F.col("base") + way) % 2 == 1).withColumn("on_border", F.coalesce(F.exists(own, lambda e: _on_segment(e, px, py)), F.lit(False)))


def inside(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with ``inside`` (even-odd) and ``on_border`` for one boundary, whose
    edges may come from several parts and holes.  Points without coordinates are outside."""
    no = [F.lit(False).alias("inside"), F.lit(False).alias("on_border")]
    cells = boundary_cells(edges.withColumn("code", F.lit(0)))
    if cells is None:
        return points.select("*", *no)
    px, py = F.col(x), F.col(y)
    in_box = F.coalesce(px.between(cells.x0, cells.x0 + cells.w) & py.between(cells.y0, cells.y0 + cells.h) & ~F.isnan(px) & ~F.isnan(py), F.lit(False))
    names = {c: f"_{c}" for c in (*CELL, "base", "edges", "code") if c in points.columns}  # a clash with a cell's own columns
    own = points.withColumnsRenamed(names)
    cx, cy = names.get(x, x), names.get(y, y)
    met = _placed(own.where(in_box), cells, cx, cy).join(cells.leaves, CELL)
    found = _sided(met, cells, cx, cy).drop(*CELL, "base", "edges", "code").withColumnsRenamed({v: k for k, v in names.items()})
    return found.select(*points.columns, "inside", "on_border").union(points.where(~in_box).select("*", *no))


def locate(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", border: bool = True) -> DataFrame:
    """``points`` with ``boundary``, one row for each boundary (``code``) that holds them;
    ``border`` says whether its border does."""
    cells = boundary_cells(edges)
    if cells is None:
        return points.withColumn("boundary", F.lit(None)).limit(0)
    kept = cells.leaves.where("edges IS NOT NULL OR base = 1").withColumnRenamed("code", "boundary")
    found = _sided(_placed(points, cells, x, y).join(kept, CELL), cells, x, y)
    held = (F.col("inside") | F.col("on_border")) if border else (F.col("inside") & ~F.col("on_border"))
    return found.where(held).select(*points.columns, "boundary")
