"""Nearest points on clustered data: exact, and cells stay small where points are dense."""

import numpy as np
from pyspark.sql import functions as F

from addrgrid.operators import knn


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    far = rng.uniform(0, 1_000_000, (n // 10, 2))
    towns = [c + rng.normal(0, 50, (n * 3 // 10, 2)) for c in ((250_000, 250_000), (250_400, 250_000), (900_000, 100_000))]
    return np.round(np.vstack([far, *towns]), 3)


def test_exact_on_clusters_with_bounded_cells(spark):
    pts = clustered(1, 20_000)
    q = np.vstack([clustered(2, 300), [[-5e5, 2e6], [250_200, 250_000]]])
    P = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "pid long, x double, y double")
    Q = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "rid long, qx double, qy double")
    got = {r.rid: (r.pid, r.distance) for r in knn.nearest_points(Q, P, "rid", "pid").collect()}
    assert len(got) == len(q)
    for k, (x, y) in enumerate(q):
        d = np.hypot(pts[:, 0] - x, pts[:, 1] - y)
        assert abs(got[k][1] - d.min()) < 1e-9 and d[got[k][0]] - d.min() < 1e-9
    D = P.groupBy(F.col("x").alias("_px"), F.col("y").alias("_py")).agg(F.min("pid").alias("_pid"))
    ox, oy, top = knn._extent(D, "_px", "_py")
    nodes, placed = knn.density_tree(D, ox, oy, top, 6, 8, 64)
    assert nodes.where("leaf").agg(F.max("n")).first()[0] <= 64
    assert placed.count() == D.count() and placed.groupBy("_pid").count().where("count > 1").count() == 0
    depth = nodes.where("leaf").agg(F.min("lvl"), F.max("lvl")).first()
    assert depth[0] <= 2 and depth[1] == 5  # towns are split further than the land between


def test_no_points_and_one_point(spark):
    Q = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 1.0), (3, None, 1.0)], "rid long, qx double, qy double")
    none = spark.createDataFrame([], "pid long, x double, y double")
    assert knn.nearest_points(Q, none, "rid", "pid").collect() == []
    one = spark.createDataFrame([(7, 5.0, 5.0), (8, 5.0, 5.0)], "pid long, x double, y double")
    assert [(r.rid, r.pid) for r in knn.nearest_points(Q, one, "rid", "pid").collect()] == [(1, 7)]
