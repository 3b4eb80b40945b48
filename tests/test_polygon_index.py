"""Detailed polygons: slabs and marked cells against a brute-force ray cast."""

import numpy as np
from pyspark.sql import functions as F

from addrgrid.operators import spatial


def star(n, cx, cy, seed, teeth=40):
    rng = np.random.default_rng(seed)
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 1000 + 150 * np.sin(teeth * a) + rng.uniform(-2, 2, n)
    return np.column_stack([cx + r * np.cos(a), cy + r * np.sin(a)])


def inside(pts, ring):
    ax, ay = ring[:, 0], ring[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    out = np.zeros(len(pts), bool)
    for k, (x, y) in enumerate(pts):
        s = (ay > y) != (by > y)
        out[k] = np.count_nonzero(x < (bx[s] - ax[s]) * (y - ay[s]) / (by[s] - ay[s]) + ax[s]) % 2
    return out


def polygons(spark, rings):
    close = lambda r: [(float(x), float(y)) for x, y in [*r, r[0]]]
    return spark.createDataFrame([(i, [[close(r)]]) for i, r in rings],
                                 "pid string, geom array<array<array<struct<x:double,y:double>>>>")


def test_detailed_polygons_equal_brute_force(spark):
    rings = [("big", star(5000, 0, 0, 1)), ("other", star(300, 900, 200, 2)), ("same", star(300, 900, 200, 2)),
             ("small", np.array([[0, 0], [400, 0], [400, 400], [0, 400]]) + 0.5)]
    polys = polygons(spark, rings)
    rng = np.random.default_rng(3)
    pts = rng.uniform(-1400, 2200, (3000, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "id long, x double, y double")
    for cell in (None, 60.0, 5000.0):
        got = {(r.id, r.pid) for r in spatial.point_in_polygon_join(points, polys, cell=cell).collect()}
        assert got == {(int(k), i) for i, ring in rings for k in np.flatnonzero(inside(pts, ring))}


def test_points_on_the_boundary_of_a_detailed_polygon(spark):
    ring = star(200, 0, 0, 4)
    polys = polygons(spark, [("p", np.round(ring))])
    on = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.round(ring))]
    points = spark.createDataFrame(on, "id long, x double, y double")
    assert spatial.point_in_polygon_join(points, polys, predicate="within").count() == 0
    assert spatial.point_in_polygon_join(points, polys, predicate="intersects").count() == len(on)


def test_edges_per_point_are_bounded_for_a_hundred_thousand_vertices(spark):
    prepared = spatial.prepare_polygons(polygons(spark, [("p", star(100_000, 0, 0, 5))]))
    cells, slabs = spatial.polygon_index(prepared, ["pid"], 100.0, "within")
    most, total = slabs.select(F.max(F.size("edges")), F.sum(F.size("edges"))).first()
    assert total < 3 * 100_000 and most < 2500  # level stretches of the outline hold the most
    mean = slabs.select(F.avg(F.size("edges"))).first()[0]
    assert mean < 100  # a thousandth of the edges
    assert cells.where("inside").count() > 200
