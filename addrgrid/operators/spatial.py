"""Spatial joins on a uniform grid.

Point-in-polygon is planned as an equi-join on grid cells (partition based
spatial merge join): every polygon is replicated to the cells its bounding
box covers, every point gets exactly one cell, so the join produces each
(point, polygon) candidate at most once. No nested-loop join is ever planned.

A polygon of up to ``INLINE_EDGES`` edges carries them and is tested by ray
cast. A more detailed one is indexed twice:

* cells that none of its edges reaches lie inside or outside as a whole; the
  inside ones are marked (their points need no test), the others dropped;
* for the remaining cells its edges are cut into horizontal slabs, about
  ``SLAB_EDGES`` to a slab. A ray towards +x only meets edges of its point's
  slab, so a point is tested against that slab, found by a second equi-join.

The ray cast's rule is the same in all three ways, and so is the result.

The polygon side is small (boundaries: thousands of rows) -- Spark's
size-checked broadcast (autoBroadcastJoinThreshold, re-checked by AQE at
runtime) ships it when it fits and falls back to a shuffle join otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

INLINE_EDGES = 64
SLAB_EDGES = 16


def prepare_polygons(polys: DataFrame, geom: str = "geom") -> DataFrame:
    """Add bbox and the flat edge list once per polygon (polygon side only)."""
    return (polys.where(F.col(geom).isNotNull())
            .select("*", *geo.bbox(geom), geo.edges(geom).alias("edges")))


def polygon_statistics(prepared: DataFrame) -> tuple[float, int]:
    """(cell side, most edges of a polygon). The side is the square root of
    the mean bbox area, so an average polygon spans about 4 cells. One
    aggregate row comes back to the driver."""
    r = prepared.agg(F.avg((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("a"),
                     F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))).alias("w"),
                     F.max(F.size("edges")).alias("n")).first()
    if r is None or r.a is None:
        return 1000.0, 0
    return max(math.sqrt(r.a) if r.a > 0 else (r.w or 1000.0), 1e-6), r.n


def choose_cell_size(prepared: DataFrame, factor: float = 1.0) -> float:
    """Cell side from the polygon table."""
    return max(polygon_statistics(prepared)[0] * factor, 1e-6)


def polygon_cells(prepared: DataFrame, cell: float) -> DataFrame:
    """Replicate each polygon over the grid cells its bbox covers."""
    g = F.lit(cell)
    return (prepared
            .withColumn("cx", F.explode(F.sequence(F.floor(F.col("minx") / g), F.floor(F.col("maxx") / g))))
            .withColumn("cy", F.explode(F.sequence(F.floor(F.col("miny") / g), F.floor(F.col("maxy") / g)))))


def _slab_of(y):
    """Slab of a height; monotone in it, so an edge's slabs are those of its ends and between."""
    return F.floor((y - F.col("miny")) / F.col("slab_height"))


def polygon_index(prepared: DataFrame, key: list[str], cell: float, predicate: str) -> tuple[DataFrame, DataFrame]:
    """(cells, slabs) of polygons with more than ``INLINE_EDGES`` edges.

    cells: key, bbox, cx, cy, slab_height and ``inside`` (true: no edge of the
    polygon reaches the cell, all of it lies inside). slabs: key, slab and the
    ``edges`` that reach its heights."""
    # slabs as high as a mean edge at least: an edge is in two of them on average, whatever the shape
    mean = F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + F.abs(e["by"] - e["ay"])) / F.size("edges")
    detailed = prepared.where(F.size("edges") > INLINE_EDGES).withColumn(
        "slab_height", F.greatest((F.col("maxy") - F.col("miny")) / F.ceil(F.size("edges") / SLAB_EDGES), mean, F.lit(1e-9)))
    box = ["minx", "miny", "maxx", "maxy", "slab_height"]
    edge = detailed.select(*key, *box, F.explode("edges").alias("e"))
    low, high = F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by")
    slabs = (edge.select(*key, F.explode(F.sequence(_slab_of(low), _slab_of(high))).alias("slab"), "e")
             .groupBy(*key, "slab").agg(F.collect_list("e").alias("edges")))
    g = F.lit(cell)
    reached = (edge.select(*key, F.explode(F.sequence(F.floor(F.least("e.ax", "e.bx") / g), F.floor(F.greatest("e.ax", "e.bx") / g))).alias("cx"),
                           low.alias("low"), high.alias("high"))
               .select(*key, "cx", F.explode(F.sequence(F.floor(F.col("low") / g), F.floor(F.col("high") / g))).alias("cy"))
               .distinct().withColumn("reached", F.lit(True)))
    cells = polygon_cells(detailed.select(*key, *box), cell).join(reached, [*key, "cx", "cy"], "left")
    # the middle of a cell that no edge reaches tells for all of it
    middle = (cells.where(F.col("reached").isNull())
              .select("*", ((F.col("cx") + 0.5) * g).alias("mx"), ((F.col("cy") + 0.5) * g).alias("my"))
              .withColumn("slab", _slab_of(F.col("my"))).join(slabs, [*key, "slab"])
              .where(_test(predicate, "mx", "my")).select(*key, *box, "cx", "cy", F.lit(True).alias("inside")))
    edges = cells.where("reached").select(*key, *box, "cx", "cy", F.lit(False).alias("inside"))
    return edges.unionByName(middle), slabs


def _test(predicate: str, x: str, y: str):
    return F.expr(geo.point_within_sql(x, y, "edges") if predicate == "within" else geo.point_intersects_sql(x, y, "edges"))


def point_in_polygon_join(points: DataFrame, polys: DataFrame, x: str = "x", y: str = "y",
                          cell: float | None = None, predicate: str = "within",
                          keep: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """All (point, polygon) pairs with the point inside the polygon.

    predicate: 'within' (ST_Within, boundary excluded) or 'intersects'
    (ST_Intersects, boundary included). ``keep`` lists the polygon columns
    to carry (default: all but geometry helpers).
    """
    prepared = prepare_polygons(polys, geom)
    box = ["minx", "miny", "maxx", "maxy"]
    own_cell, most_edges = polygon_statistics(prepared)
    cell = cell or own_cell
    keep = keep or [c for c in polys.columns if c != geom]
    g = F.lit(cell)
    pts = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        "*", F.floor(F.col(x) / g).alias("_pcx"), F.floor(F.col(y) / g).alias("_pcy"))
    here = (F.col("_pcx") == F.col("cx")) & (F.col("_pcy") == F.col("cy"))
    in_box = ((F.col(x) >= F.col("minx")) & (F.col(x) <= F.col("maxx"))
              & (F.col(y) >= F.col("miny")) & (F.col(y) <= F.col("maxy")))
    out = [*points.columns, *keep]
    plain = polygon_cells(prepared.where(F.size("edges") <= INLINE_EDGES), cell).select(*keep, *box, "edges", "cx", "cy")
    found = pts.join(plain, here).where(in_box & _test(predicate, x, y)).select(*out)
    if most_edges <= INLINE_EDGES:
        return found
    # polygons of equal shape have one index
    numbered = prepared.where(F.size("edges") > INLINE_EDGES).withColumn("_poly", F.xxhash64(geom))
    cells, slabs = polygon_index(numbered.dropDuplicates(["_poly"]), ["_poly"], cell, predicate)
    names = numbered.select("_poly", *keep)
    met = pts.join(cells, here).where(in_box).withColumn("slab", _slab_of(F.col(y)))
    marked = met.where("inside").select(*points.columns, "_poly")
    tested = (met.where("not inside").join(slabs, ["_poly", "slab"]).where(_test(predicate, x, y))
              .select(*points.columns, "_poly"))
    return found.unionByName(marked.unionByName(tested).join(names, "_poly").select(*out))


def first_containing(points: DataFrame, polys: DataFrame, point_key: str, poly_key: str,
                     x: str = "x", y: str = "y", carry: list[str] | None = None,
                     cell: float | None = None, predicate: str = "within") -> DataFrame:
    """C6/C13 helper: per point, the containing polygon with the smallest key
    (rule D for an unordered LIMIT 1). Output: point_key, poly_key, *carry."""
    carry = carry or []
    pip = point_in_polygon_join(points.select(point_key, x, y), polys.select(poly_key, *carry, "geom"),
                                x=x, y=y, cell=cell, predicate=predicate, keep=[poly_key, *carry])
    best = pip.groupBy(point_key).agg(F.min(poly_key).alias(poly_key),
                                      *[F.min_by(c, poly_key).alias(c) for c in carry])
    return best
