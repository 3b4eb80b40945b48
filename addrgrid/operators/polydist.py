"""Polygon-to-polygon distance and the nearest-polygon cascade.

Distance between two polygons is 0 when they intersect (a boundary crossing
or one containing the other), else the smallest segment-to-segment distance
of their boundaries. Exact, without forming every edge pair of a polygon
pair: segments are bucketed into grid cells of side ``r`` (one side's cells
expanded by ``r``), so only segments closer than about ``r`` meet in a cell.
Duplicated pairs are harmless because only the minimum is kept.

The nearest polygon search expands ``r`` geometrically over a fixed number of
rounds (``r0 * 2^k``), each round only for the still-unresolved rows, and the
last round covers the whole extent, so every row is answered exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage


def _pt_seg(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.when(len2 == 0, 1.0).otherwise(len2))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segment_distance(a, b) -> Column:
    """Distance between segments a=(ax,ay,bx,by) and b (Columns), 0 if they touch."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    o1, o2 = _orient(ax, ay, bx, by, cx, cy), _orient(ax, ay, bx, by, dx, dy)
    o3, o4 = _orient(cx, cy, dx, dy, ax, ay), _orient(cx, cy, dx, dy, bx, by)
    cross = (o1 * o2 < 0) & (o3 * o4 < 0)
    m = F.least(_pt_seg(ax, ay, cx, cy, dx, dy), _pt_seg(bx, by, cx, cy, dx, dy),
                _pt_seg(cx, cy, ax, ay, bx, by), _pt_seg(dx, dy, ax, ay, bx, by))
    return F.when(cross, F.lit(0.0)).otherwise(m)


def _segments(polys: DataFrame, key: str, r: float, expand: float) -> DataFrame:
    e = polys.select(key, F.explode(geo.edges("geom")).alias("e"))
    g = F.lit(r)
    x0 = F.least("e.ax", "e.bx") - expand
    x1 = F.greatest("e.ax", "e.bx") + expand
    y0 = F.least("e.ay", "e.by") - expand
    y1 = F.greatest("e.ay", "e.by") + expand
    return (e.withColumn("cx", F.explode(F.sequence(F.floor(x0 / g), F.floor(x1 / g))))
            .withColumn("cy", F.explode(F.sequence(F.floor(y0 / g), F.floor(y1 / g)))))


def pair_distance(pairs: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str, r: float) -> DataFrame:
    """Exact distance for candidate pairs whose distance is at most ``r``
    (pairs farther apart come back as null or as an upper bound > r).

    Returns (a_key, b_key, distance)."""
    sa = _segments(a.join(pairs.select(a_key).distinct(), a_key, "left_semi"), a_key, r, r)
    sb = _segments(b.join(pairs.select(b_key).distinct(), b_key, "left_semi"), b_key, r, 0.0)
    sa = sa.select(a_key, "cx", "cy", F.col("e.ax").alias("a_ax"), F.col("e.ay").alias("a_ay"),
                   F.col("e.bx").alias("a_bx"), F.col("e.by").alias("a_by"))
    sb = sb.select(b_key, "cx", "cy", F.col("e.ax").alias("b_ax"), F.col("e.ay").alias("b_ay"),
                   F.col("e.bx").alias("b_bx"), F.col("e.by").alias("b_by"))
    j = pairs.join(sa, a_key).join(sb, [b_key, "cx", "cy"])
    d = segment_distance((F.col("a_ax"), F.col("a_ay"), F.col("a_bx"), F.col("a_by")),
                         (F.col("b_ax"), F.col("b_ay"), F.col("b_bx"), F.col("b_by")))
    seg = j.groupBy(a_key, b_key).agg(F.min(d).alias("distance"))
    # containment without a boundary crossing: a part of one inside the other,
    # so its shell's first vertex is (one test vertex per part)
    starts = F.transform("geom", lambda part: part[0][0])
    av = a.select(a_key, starts.alias("a_starts"), geo.edges("geom").alias("a_edges"))
    bv = b.select(b_key, starts.alias("b_starts"), geo.edges("geom").alias("b_edges"))
    c = pairs.join(av, a_key).join(bv, b_key)
    inside = (F.expr(f"exists(b_starts, w -> {geo.point_intersects_sql('w.x', 'w.y', 'a_edges')})")
              | F.expr(f"exists(a_starts, v -> {geo.point_intersects_sql('v.x', 'v.y', 'b_edges')})"))
    cont = c.where(inside).select(a_key, b_key, F.lit(0.0).alias("distance"))
    return seg.unionByName(cont).groupBy(a_key, b_key).agg(F.min("distance").alias("distance"))


def candidate_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, r: float) -> DataFrame:
    """Distinct (a_key, b_key) whose bboxes are within ``r``: grid equi-join
    on cells of side r (a's bbox expanded by r)."""
    g = F.lit(r)
    ab = a.select(a_key, *geo.bbox("geom"))
    bb = b.select(b_key, *geo.bbox("geom"))
    ca = (ab.withColumn("cx", F.explode(F.sequence(F.floor((F.col("minx") - r) / g), F.floor((F.col("maxx") + r) / g))))
          .withColumn("cy", F.explode(F.sequence(F.floor((F.col("miny") - r) / g), F.floor((F.col("maxy") + r) / g))))
          .select(a_key, "cx", "cy"))
    cb = (bb.withColumn("cx", F.explode(F.sequence(F.floor(F.col("minx") / g), F.floor(F.col("maxx") / g))))
          .withColumn("cy", F.explode(F.sequence(F.floor(F.col("miny") / g), F.floor(F.col("maxy") / g))))
          .select(b_key, "cx", "cy"))
    return ca.join(cb, ["cx", "cy"]).select(a_key, b_key).distinct()


def nearest_polygon(a: DataFrame, b: DataFrame, a_key: str, b_key: str, r0: float = 10000.0,
                    rounds: int | None = None) -> DataFrame:
    """For each polygon of ``a`` the polygon of ``b`` at the smallest distance
    (ties: smallest key): (a_key, b_key, distance).

    Round k probes ``b`` polygons whose bbox lies within r0*2^k of the ``a``
    bbox (grid equi-join), computes exact distances and accepts the best one
    if it is within the radius; the rest go to the next round. The last
    round's radius spans the joint extent, so nothing is left unanswered.
    """
    ab = a.select(a_key, "geom", *geo.bbox("geom"))
    bb = b.select(b_key, "geom", *geo.bbox("geom"))
    ext = ab.unionByName(bb.withColumnRenamed(b_key, a_key), allowMissingColumns=True).agg(
        (F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny"))).alias("e")).first().e or 1.0
    if rounds is None:
        # the last radius must reach the joint bbox diagonal
        rounds = max(1, int(math.ceil(math.log2(max(math.sqrt(2.0) * ext / r0, 1.0)))) + 1)
    todo = cut_lineage(ab)
    found = None
    for k in range(rounds):
        if k > 0 and todo.isEmpty():  # one boolean to the driver per round
            break
        r = r0 * (2 ** k)
        pairs = candidate_pairs(todo, b, a_key, b_key, r)
        dist = pair_distance(pairs, todo.select(a_key, "geom"), b.select(b_key, "geom"), a_key, b_key, r)
        best = (dist.where(F.col("distance") <= r)
                .groupBy(a_key).agg(F.min(F.struct("distance", b_key)).alias("m"))
                .select(a_key, F.col("m." + b_key).alias(b_key), F.col("m.distance").alias("distance")))
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        todo = cut_lineage(todo.join(best.select(a_key), a_key, "left_anti"))
    return found
