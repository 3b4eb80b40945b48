"""Exact nearest neighbour for a whole table of requests.

A tree that follows the density of the points, descended by a fixed number of
joins (no loop over rows, no cross join):

* cells are split into ``fanout x fanout`` children until each holds at most
  ``leaf_points`` points (or the finest level is reached), so a dense town is
  divided further than empty land and no cell gathers many points; each node
  keeps its count and one representative point;
* each request starts with the occupied cells of the coarsest level and walks
  down: a cell that is split is replaced by its occupied children (joined by
  their parent), a leaf stays. The distance to the nearest representative is an
  upper bound (a representative is a real point), and every cell whose
  rectangle is farther than that bound is dropped. The coarsest cells, at most
  ``fanout^2``, are a constant of the request's row; below, children beyond
  the bound of the level above go before the shuffle that finds the next one;
* the surviving leaves are joined to their points and the minimum
  ``(distance, point key)`` wins (ties -> smallest key).

A cell holding the true nearest point is never dropped, so the result is
exact. The bound is at most d* + one cell diagonal at each level, so a request
only keeps the cells around it; the work per request does not grow with the
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


#: coordinates beyond this are no place on the grid (and never finite by accident)
FARTHEST = 1e15


def _on_grid(x, y):
    """Not null, not NaN, not infinite: NaN sorts above every number in Spark."""
    return F.col(x).between(-FARTHEST, FARTHEST) & F.col(y).between(-FARTHEST, FARTHEST)


def _extent(points: DataFrame, px, py):
    """Origin and side of the square that holds all points. Requests have no
    say: far-off ones must not stretch the cells, and distances are computed
    from coordinates, never from a request's own cell."""
    a = points.agg(F.min(px).alias("x0"), F.min(py).alias("y0"), F.max(px).alias("x1"),
                   F.max(py).alias("y1")).first()
    if a.x0 is None:
        return 0.0, 0.0, 1.0
    return a.x0, a.y0, max(a.x1 - a.x0, a.y1 - a.y0, 1e-6) * 1.000001


def density_tree(points: DataFrame, ox: float, oy: float, top: float, levels: int, fanout: int,
                 leaf_points: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, placed points) of points (_pid, _px, _py) with distinct coordinates.

    nodes: lvl, cx, cy, pcx, pcy (the parent's cell), leaf, n and the
    representative. placed: the points with the lvl, cx, cy of their leaf."""
    f, size = F.lit(fanout), top / float(fanout) ** levels
    own = points.select("_pid", "_px", "_py", F.floor((F.col("_px") - ox) / size).alias("fx"),
                        F.floor((F.col("_py") - oy) / size).alias("fy"),
                        F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lvl"))
    div = F.pow(f, F.col("lvl")).cast("long")
    own = own.select("_pid", "_px", "_py", "lvl", F.floor(F.col("fx") / div).alias("cx"), F.floor(F.col("fy") / div).alias("cy"))
    # min_by on primitives keeps the aggregate hash based with map-side partial aggregation
    cells = cut_lineage(own.groupBy("lvl", "cx", "cy").agg(
        F.count("*").alias("n"), F.min("_pid").alias("_pid"), F.min_by("_px", "_pid").alias("_px"), F.min_by("_py", "_pid").alias("_py"))
        .withColumn("pcx", F.floor(F.col("cx") / f)).withColumn("pcy", F.floor(F.col("cy") / f)))
    split = cells.where(F.col("n") > leaf_points).select((F.col("lvl") - 1).alias("lvl"), F.col("cx").alias("pcx"), F.col("cy").alias("pcy"))
    nodes = cells.join(split, ["lvl", "pcx", "pcy"], "left_semi").unionByName(cells.where(F.col("lvl") == levels - 1))
    nodes = cut_lineage(nodes.withColumn("leaf", (F.col("n") <= leaf_points) | (F.col("lvl") == 0)))
    return nodes, own.join(nodes.where("leaf").select("lvl", "cx", "cy"), ["lvl", "cx", "cy"])


def nearest_points(requests: DataFrame, points: DataFrame, req_key: str, pt_key: str,
                   qx: str = "qx", qy: str = "qy", px: str = "x", py: str = "y",
                   levels: int = 6, fanout: int = 8, dedupe_coordinates: bool = True, leaf_points: int = 64) -> DataFrame:
    """For each request, the nearest point: (req_key, pt_key, distance).

    Requests without finite coordinates or with an empty point table get no
    row (left-join the result to keep them); they do not touch the others.
    Points of one coordinate count once, for their smallest key.
    """
    P = points.where(_on_grid(px, py)).select(
        F.col(pt_key).alias("_pid"), F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py"))
    if dedupe_coordinates:
        # identical coordinates: only the smallest key can win
        P = P.groupBy("_px", "_py").agg(F.min("_pid").alias("_pid"))
    P = cut_lineage(P)
    # stored before the filter, which would repeat the whole projection of the coordinates in its code; spread by
    # key, since a small file of requests comes in few parts and every level asks for this distribution
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    R = cut_lineage(requests.select(F.col(req_key).alias("_rid"), F.col(qx).cast("double").alias("_qx"),
                                    F.col(qy).cast("double").alias("_qy")).repartition(tasks, "_rid")).where(_on_grid("_qx", "_qy"))
    ox, oy, top = _extent(P, "_px", "_py")
    nodes, placed = density_tree(P, ox, oy, top, levels, fanout, leaf_points)
    deepest = nodes.agg(F.min("lvl")).first()[0]

    def spans(lvl, cx, cy, x, y):
        """Least distance to the cell (less what rounding may take), distance to its representative."""
        s = F.lit(top) / F.pow(F.lit(float(fanout)), F.lit(levels) - lvl)
        x0, y0 = F.lit(ox) + cx * s, F.lit(oy) + cy * s
        dx = F.greatest(x0 - F.col("_qx"), F.lit(0.0), F.col("_qx") - (x0 + s))
        dy = F.greatest(y0 - F.col("_qy"), F.lit(0.0), F.col("_qy") - (y0 + s))
        return F.hypot(dx, dy) - F.lit(top * 1e-12), F.hypot(x - F.col("_qx"), y - F.col("_qy"))

    cell = ["lvl", "cx", "cy", "leaf", "_px", "_py"]
    # coarsest level: at most fanout^2 cells cover the whole extent, weighed in each request's row
    tops = nodes.where(F.col("lvl") == levels - 1).select(*cell).collect()
    known = F.array(*[F.struct(*[F.lit(t[c]).alias(c) for c in cell]) for t in tops]).cast(
        T.ArrayType(nodes.select(*cell).schema))
    weighed = F.transform(known, lambda t: F.struct(t.alias("t"), *[v.alias(n) for v, n in zip(
        spans(t["lvl"], t["cx"], t["cy"], t["_px"], t["_py"]), ("mind", "repd"))]))
    cand = R.select("_rid", "_qx", "_qy", weighed.alias("_w")).withColumn("_ub", F.array_min(F.transform("_w", lambda w: w["repd"])))
    cand = cand.select("_rid", "_qx", "_qy", "_ub", F.explode(F.filter("_w", lambda w: w["mind"] <= F.col("_ub"))).alias("_w"))
    cand = cand.select("_rid", "_qx", "_qy", "_ub", "_w.t.*")
    for k in range(levels - 2, (levels if deepest is None else deepest) - 1, -1):
        kids = nodes.where(F.col("lvl") == k).select(
            F.col("pcx").alias("k_px"), F.col("pcy").alias("k_py"), *[F.col(c).alias(f"k_{c}") for c in ("lvl", "cx", "cy", "leaf")],
            F.col("_px").alias("k_x"), F.col("_py").alias("k_y"))
        both = cand.join(kids, ~F.col("leaf") & (F.col("cx") == F.col("k_px")) & (F.col("cy") == F.col("k_py")), "left")
        both = both.select("_rid", "_qx", "_qy", "_ub", *[F.coalesce(f"k_{c}", c).alias(c) for c in ("lvl", "cx", "cy", "leaf")],
                           F.coalesce("k_x", "_px").alias("_px"), F.coalesce("k_y", "_py").alias("_py"))
        mind, repd = spans(*[F.col(c) for c in ("lvl", "cx", "cy", "_px", "_py")])
        # the bound of the level above holds here too: cells beyond it never reach the shuffle
        both = both.withColumn("_mind", mind).where(F.col("_mind") <= F.col("_ub")).withColumn("_repd", repd)
        both = both.withColumn("_ub", F.least("_ub", F.min("_repd").over(Window.partitionBy("_rid"))))
        cand = both.where(F.col("_mind") <= F.col("_ub")).select("_rid", "_qx", "_qy", "_ub", *cell)
    hits = cand.select("_rid", "_qx", "_qy", "lvl", "cx", "cy").join(placed, ["lvl", "cx", "cy"]).select(
        "_rid", F.struct(F.hypot(F.col("_px") - F.col("_qx"), F.col("_py") - F.col("_qy")).alias("d"),
                         F.col("_pid").alias("p")).alias("_h"))
    best = hits.groupBy("_rid").agg(F.min("_h").alias("_b"))
    best = cut_lineage(best)
    return best.select(F.col("_rid").alias(req_key), F.col("_b.p").alias(pt_key), F.col("_b.d").alias("distance"))
