"""Operator tests: grid joins against brute force, KNN exactness, load
idioms, verify quirks on literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrgrid.functions import geo
from addrgrid.operators import hierarchy, knn, load, spatial, verify
from addrgrid.sources import fixtures as fx

from conftest import SF


def test_grid_pip_equals_brute_force(spark):
    pts = fx.points(spark, SF)
    subs = fx.suburbs(spark, SF)
    grid = {(r.address_id, r.suburb_id) for r in
            spatial.point_in_polygon_join(pts, subs.select("suburb_id", "geom"), keep=["suburb_id"]).collect()}
    e = subs.select("suburb_id", geo.edges("geom").alias("edges"))
    brute = {(r.address_id, r.suburb_id) for r in
             pts.join(e).where(geo.point_within("x", "y")).select("address_id", "suburb_id").collect()}
    assert grid == brute


def test_resolve_invariant_district_region(spark):
    r = hierarchy.resolve_hierarchy(fx.points(spark, SF), fx.suburbs(spark, SF), fx.districts(spark, SF),
                                    key="address_id").collect()
    assert len(r) == 1500
    for x in r:
        assert x.district_id is not None and int(x.district_id) % 5 == int(x.region_id)


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(7)
    p = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1000, size=(400, 2)))]
    p += [(1000, 500.0, 500.0), (1001, 500.0, 500.0)]  # duplicate coordinates: smaller key wins
    q = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-500, 1500, size=(200, 2)))]
    q.append((999, 500.0, 500.0))
    P = spark.createDataFrame(p, "pid long, x double, y double")
    Q = spark.createDataFrame(q, "rid long, qx double, qy double")
    got = {r.rid: (r.pid, r.distance) for r in knn.nearest_points(Q, P, "rid", "pid", levels=3, fanout=4).collect()}
    pa = np.array([(a, b) for _, a, b in p])
    ids = np.array([i for i, _, _ in p])
    for rid, qx, qy in q:
        d = np.hypot(pa[:, 0] - qx, pa[:, 1] - qy)
        best = ids[d == d.min()].min()
        assert got[rid][0] == best
    assert got[999][0] == 1000


def test_upsert_and_duplicate_guard(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "address_id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "address_id long, v string")
    out = {r.address_id: r.v for r in load.upsert(old, new, "address_id").collect()}
    assert out == {1: "a", 2: "B", 3: "C"}
    dup = spark.createDataFrame([(2, "x"), (2, "y")], "address_id long, v string")
    with pytest.raises(Exception):
        load.upsert(old, dup, "address_id").collect()


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("1", "a")], "k string, v string")
    inc = spark.createDataFrame([("1", "z"), ("2", "c"), ("2", "b")], "k string, v string")
    out = sorted((r.k, r.v) for r in load.insert_if_absent(old, inc, "k", order_by=["v"]).collect())
    assert out == [("1", "a"), ("2", "b")]


def _mini_tables(spark):
    feed = spark.createDataFrame([
        (1, 14, "Hill Street", "Kelburn", "Wellington", "14 Hill Street, Kelburn, Wellington", 174.77, -41.28, "Current"),
        (2, 14, "Hill Road", "Hillcrest", "Hamilton", "14 Hill Road, Hillcrest, Hamilton", 175.3, -37.8, "Current"),
        (3, 5, "Chaytors Spring Road", "Oxford", "Oxford", "5 Chaytors Spring Road, Oxford", 172.2, -43.3, "Current"),
        (4, 7, "Tui Lane", "Te Aro", "Wellington", "7 Tui Lane, Te Aro, Wellington", 174.78, -41.29, "Retired"),
    ], "address_id long, address_number int, full_road_name string, suburb_locality string, town_city string, "
       "full_address string, gd2000_xcoord double, gd2000_ycoord double, address_lifecycle string")
    for c in ("full_address_ascii", "full_road_name_ascii", "suburb_locality_ascii", "address_number_prefix",
              "address_number_suffix", "territorial_authority"):
        feed = feed.withColumn(c, F.lit(None).cast("string"))
    return load.load_addresses(feed)


def test_verify_quirks_on_literal_table(spark):
    a = _mini_tables(spark)
    subs = fx.suburbs(spark, SF).limit(0)
    dists = fx.districts(spark, SF).limit(0)
    raw = spark.createDataFrame([(1, "14 hill"), (2, "14 Hill Road Hamilton"), (3, "5 chaytors spring creek"),
                                 (4, "   "), (5, "7 tui lane"), (6, "14")], "raw_id long, raw_address string")
    v = {r.raw_id: r for r in verify.verify(raw, a, subs, dists).collect()}
    assert (v[1].strategy, v[1].address_id, v[1].message) == ("exact", 1, "Match found")
    assert (v[2].strategy, v[2].address_id) == ("smart", 2)
    assert v[2].message == "Unique match found"
    assert (v[3].strategy, v[3].address_id) == ("smart", 3)   # two-word retry
    assert v[4].message == "Address cannot be empty"
    assert v[5].exists_in_source is False                     # retired row not loaded
    assert (v[6].strategy, v[6].address_id) == ("exact", 1)   # number only matches any road


def _py_trigrams(s):
    import re
    out = set()
    for w in re.split(r"[^\w]+|_", s.lower()):
        if w:
            p = "  " + w + " "
            out.update(p[i:i + 3] for i in range(len(w) + 1))
    return out


def test_similarity_join_exact_against_brute_force(spark):
    from addrgrid.operators import matching
    rng = np.random.default_rng(11)
    words = ["kowhai", "rata", "tui", "hill", "mill", "spring", "beach", "road", "street", "lane", "north", "bay"]
    addrs = [(i, f"{rng.integers(1, 30)} {rng.choice(words)} {rng.choice(words)} {rng.choice(words)}")
             for i in range(300)]
    reqs = []
    for i in range(120):
        base = addrs[int(rng.integers(0, 300))][1]
        mode = i % 3
        t = base if mode == 0 else (base + " x" if mode == 1 else " ".join(rng.choice(words, 3)))
        reqs.append((i, t))
    A = spark.createDataFrame(addrs, "address_id long, full_address_ascii string")
    R = spark.createDataFrame(reqs, "rid long, norm string")
    got = {r.rid: (r.address_id, r.sim) for r in matching.similarity_join(R, A, "rid", "norm").collect()}
    ag = {i: _py_trigrams(t) for i, t in addrs}
    for rid, text in reqs:
        g = _py_trigrams(text)
        best = None
        for aid, h in ag.items():
            if not g or not h:
                continue
            s = float(np.float32(len(g & h) / len(g | h)))
            if s > 0.6 and (best is None or s > best[1] or (s == best[1] and aid < best[0])):
                best = (aid, s)
        if best is None:
            assert rid not in got
        else:
            assert got[rid][0] == best[0] and abs(got[rid][1] - best[1]) < 1e-6


def test_overlap_area_with_hole_and_orientation(spark):
    from addrgrid.functions import geo as g
    # child: 10x10 square with a 4x4 hole (clockwise shell); parents: left half, right half
    child = "POLYGON((0 0,0 10,10 10,10 0,0 0),(1 1,5 1,5 5,1 5,1 1))"
    left = "POLYGON((0 0,5 0,5 10,0 10,0 0))"
    right = "POLYGON((5 0,20 0,20 10,5 10,5 0))"
    c = spark.createDataFrame([("c", child)], "k string, w string").select("k", g.geom_from_wkt("w").alias("geom"))
    p = spark.createDataFrame([("L", left), ("R", right)], "pk string, w string").select(
        "pk", g.geom_from_wkt("w").alias("geom"))
    r = load.parent_by_overlap(c.withColumn("geom", F.col("geom")), p, "k", "pk", cell=5.0).first()
    # left half keeps 50 - 16 = 34, right half 50 -> right wins with 50
    assert r.pk == "R" and abs(r.overlap_area - 50.0) < 1e-6
    p2 = spark.createDataFrame([("L", left)], "pk string, w string").select("pk", g.geom_from_wkt("w").alias("geom"))
    r2 = load.parent_by_overlap(c, p2, "k", "pk", cell=5.0).first()
    assert abs(r2.overlap_area - 34.0) < 1e-6


def test_autocomplete_wildcards_only_and_clamp(spark):
    from addrgrid.operators import search
    a = spark.createDataFrame([(1, "Ab", "x", "x", "x", "x"), (2, "Abcd", "x", "x", "x", "x"),
                               (3, "Abcde", "x", "x", "x", "x"), (4, "Zz Top", "x", "x", "x", "x")],
                              "address_id long, full_address_ascii string, full_address string, "
                              "full_road_name string, suburb_locality string, town_city string")
    q = spark.createDataFrame([(1, "%%%"), (2, "____"), (3, "bcd"), (4, "ab")], "query_id long, query string")
    out = {}
    for r in search.autocomplete(q, a, limit=99).collect():   # 99 is clamped to 10
        out.setdefault(r.query_id, []).append((r.rank, r.address_id))
    assert sorted(out[1]) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert sorted(out[2]) == [(1, 2), (2, 3), (3, 4)]          # length >= 4
    assert sorted(out[3]) == [(1, 2), (2, 3)]
    assert 4 not in out                                         # shorter than 3 characters


def test_suburb_cascade_with_flip_and_projection(spark):
    from addrgrid.functions import geo as g
    # district: NZTM square around central Wellington
    d = spark.createDataFrame([("D1", "POLYGON((1700000 5400000,1800000 5400000,1800000 5470000,"
                                      "1700000 5470000,1700000 5400000))")], "district_id string, w string")
    d = d.select("district_id", g.geom_from_wkt("w").alias("geom"))
    # suburbs in latitude/longitude order (flipped feed), degrees
    inside = "POLYGON((-41.29 174.77,-41.29 174.78,-41.28 174.78,-41.28 174.77,-41.29 174.77))"
    far = "POLYGON((-36.86 174.76,-36.86 174.77,-36.85 174.77,-36.85 174.76,-36.86 174.76))"
    st = spark.createDataFrame([("1", "Te Aro", None, inside), ("2", "Far", "", far)],
                               "id string, name string, major_name string, w string")
    st = st.select("id", "name", "major_name", g.geom_from_wkt("w").alias("geom"))
    out = {r.suburb_id: r for r in load.load_suburbs_cascade(st, d, flip=True, project=True).collect()}
    assert (out["1"].district_id, out["1"].method) == ("D1", "contains")
    assert (out["2"].district_id, out["2"].method) == ("D1", "nearest") and out["2"].distance > 400000
    assert out["1"].major_name == ""                       # null major name defaults to ''
    x = out["1"].geom[0][0][0].x
    assert 1.74e6 < x < 1.76e6                              # projected to NZTM metres


def test_browse_order_and_simple_classification(spark):
    subs = spark.createDataFrame([("1", "D", "Zeta", None), ("2", "D", "Ponsonby", ""), ("3", "D", "Alpha", "X")],
                                 "suburb_id string, district_id string, name string, major_name string")
    full = hierarchy.classify_suburbs(subs)
    streets = spark.createDataFrame([("1", "A St"), ("1", "B St"), ("3", "C St")], "suburb_id string, street_name string")
    view = hierarchy.suburbs_view(full, streets)
    rows = hierarchy.browse_suburbs(view, spark.createDataFrame([("D",)], "district_id string")).collect()
    # major first (sort priority 0), then by name; name_ascii null, major_name echoes the name
    assert [r.name for r in rows] == ["Ponsonby", "Alpha", "Zeta"]
    assert rows[0].population_category == "major" and rows[1].population_category == "medium"
    assert rows[2].street_count == 2 and rows[0].name_ascii is None and rows[1].major_name == "Alpha"
    simple = {r.suburb_id: (r.is_major_suburb, r.population_category)
              for r in hierarchy.classify_suburbs(subs, simple=True).collect()}
    assert simple == {"1": (False, "minor"), "2": (True, "medium"), "3": (True, "medium")}


def test_verify_short_street_patterns(spark):
    a = _mini_tables(spark)
    subs = fx.suburbs(spark, SF).limit(0)
    dists = fx.districts(spark, SF).limit(0)
    raw = spark.createDataFrame([(1, "14 hi"), (2, "5 y"), (3, "14 %%"), (4, "14 zq")], "raw_id long, raw_address string")
    v = {r.raw_id: r for r in verify.verify(raw, a, subs, dists).collect()}
    assert (v[1].strategy, v[1].address_id) == ("exact", 1)   # 'hi' in Hill Street / Hill Road
    assert (v[2].strategy, v[2].address_id) == ("exact", 3)   # 'y' in Chaytors
    assert (v[3].strategy, v[3].address_id) == ("exact", 1)   # wildcards only: any road
    assert v[4].exists_in_source is False


def test_nearest_point_ignores_requests_off_the_grid(spark):
    from addrgrid.operators.knn import nearest_points
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, float("nan"), 1.0)], "pid int, x double, y double")
    asked = spark.createDataFrame([(1, 1.0, 0.0), (2, float("inf"), 0.0), (3, float("nan"), 0.0), (4, 1e9, 0.0),
                                   (5, None, 0.0)], "rid int, qx double, qy double")
    got = {r.rid: r.pid for r in nearest_points(asked, points, "rid", "pid").collect()}
    assert got == {1: 1, 4: 2}


def test_no_local_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest as pt

    from addrgrid.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pt.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)


def test_requests_and_upsert_follow_the_whole_feed(spark):
    from addrgrid.plans.catalog import QUERIES
    from addrgrid.sources import fixtures as fx
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        orders = spark.read.parquet(f"{d}/orders.parquet").count()
        assert fx.address_count(spark, d) == orders
        customers = spark.read.parquet(f"{d}/customer.parquet").count()
        assert fx.raw_requests(spark, d).count() == customers


def _polygons(spark, key, rows):
    from addrgrid.functions import geo as g
    return spark.createDataFrame(rows, f"{key} string, w string").select(key, g.geom_from_wkt("w").alias("geom"))


def test_overlap_keeps_touching_and_parentless_children(spark):
    def square(x, y):
        return f"POLYGON(({x} {y},{x + 10} {y},{x + 10} {y + 10},{x} {y + 10},{x} {y}))"

    east, north = 1700000, 5400000
    children = _polygons(spark, "k", [("edge", square(east + 10, north)), ("corner", square(east - 10, north - 10)),
                                      ("far", square(east + 500, north)), ("part", square(east + 5, north + 5)),
                                      ("none", None)])
    parents = _polygons(spark, "pk", [("P", square(east, north)), ("Q", square(east - 20, north))])
    got = {r.k: (r.pk, r.overlap_area) for r in load.parent_by_overlap(children, parents, "k", "pk", cell=25.0).collect()}
    assert got == {"edge": ("P", 0.0), "corner": ("P", 0.0), "far": (None, None), "part": ("P", 25.0),
                   "none": (None, None)}


def test_polygon_distance_of_a_part_inside(spark):
    from addrgrid.operators.polydist import pair_distance
    a = _polygons(spark, "k", [("two", "MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((22 2,23 2,23 3,22 3,22 2)))"),
                               ("one", "POLYGON((0 0,1 0,1 1,0 1,0 0))")])
    b = _polygons(spark, "pk", [("box", "POLYGON((6 0,40 0,40 10,6 10,6 0))")])
    pairs = a.select("k").crossJoin(b.select("pk"))
    for r in (20.0, 50.0):
        got = {x.k: x.distance for x in pair_distance(pairs, a, b, "k", "pk", r).collect()}
        assert got == {"two": 0.0, "one": 5.0}
        back = pair_distance(pairs, b, a, "pk", "k", r).collect()
        assert {x.k: x.distance for x in back} == got


def test_regions_without_geometry_are_dropped(spark):
    stage = _polygons(spark, "id", [("1", "POLYGON((0 0,1 0,1 1,0 1,0 0))"), ("2", None)]).withColumn("name", F.lit("n"))
    assert [r.region_id for r in load.load_regions(stage).collect()] == ["1"]
