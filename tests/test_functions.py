"""Unit tests for the column functions on small literal tables (quirks of
J8-J14, projection round trip, polygon predicates, similarity)."""

import math

from pyspark.sql import functions as F

from addrgrid.functions import geo, text, trigram


def one(spark, expr_df):
    return expr_df.collect()


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([("  12,  Queen St. Auckland ",), ("   ",), (None,), ("A B",)], "s string")
    r = df.select(text.normalize("s").alias("n"), text.tokens("s").alias("t"), text.is_blank("s").alias("b")).collect()
    assert r[0].n == "12 queen st auckland"
    assert r[0].t == ["12", "queen", "st", "auckland"]
    assert (r[1].n, r[1].b) == ("", True)
    assert (r[2].n, r[2].b) == ("", True)
    assert r[3].n == "a b"  # unicode whitespace collapses


def test_to_ascii_only_listed_characters(spark):
    df = spark.createDataFrame([("Ōwaka Māori é è ü ñ",)], "s string")
    assert df.select(text.to_ascii("s")).first()[0] == "Owaka Maori e è ü ñ"


def test_parse_int_strict(spark):
    df = spark.createDataFrame([(t,) for t in ["12", "+5", "-3", "0061", "12a", "1.5", "1e3", "2147483648", "٣"]],
                               "t string")
    got = [r[0] for r in df.select(text.parse_int("t")).collect()]
    assert got == [12, 5, -3, 61, None, None, None, None, None]


def test_smart_parse_rules(spark):
    rows = [("12 queen street auckland",), ("61 otonga rotorua",), ("14 hill",),
            ("5 chaytors spring creek",), ("hello 7 main road",), ("no number here",), ("9",)]
    df = spark.createDataFrame(rows, "s string").withColumn("toks", text.tokens("s"))
    r = text.with_smart_parse(text.with_exact_parse(df, "toks"), "toks").collect()
    assert (r[0].sm_street1, r[0].sm_city1, r[0].sm_street2) == ("queen street", "auckland", None)
    assert (r[1].sm_street1, r[1].sm_city1) == ("otonga", "rotorua")
    assert (r[2].sm_street1, r[2].sm_city1) == ("hill", None)
    assert (r[3].sm_street1, r[3].sm_city1, r[3].sm_street2, r[3].sm_city2) == (
        "chaytors", "spring creek", "chaytors spring", "creek")
    assert (r[4].sm_number, r[4].sm_street1, r[4].ex_road) == (7, "main road", "hello")
    assert r[5].sm_number is None and r[5].ex_number is None
    assert (r[6].ex_number, r[6].ex_road, r[6].sm_number) == (9, "", None)


def test_like_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("Queen Street", "qu%n"), ("Queen Street", "q_een"), ("Queen Street", "\\q"),
                                ("Queen Street", "xx")], "t string, p string")
    got = [r[0] for r in df.select(text.contains_ci("t", "p")).collect()]
    assert got == [True, True, True, False]


def test_similarity_matches_documented_value(spark):
    df = spark.createDataFrame([("word", "two words"), ("abc", "abc"), ("", "abc")], "a string, b string")
    got = [r[0] for r in df.select(trigram.similarity("a", "b")).collect()]
    assert abs(got[0] - 0.363636) < 1e-6
    assert got[1] == 1.0 and got[2] == 0.0


def test_similarity_threshold_float_rule(spark):
    # exactly 3/5 passes "> 0.6" once widened from single precision
    df = spark.createDataFrame([(0.6,)], "s float")
    assert df.select(trigram.above_threshold("s")).first()[0] is True


def test_projection_round_trip_and_reference_point(spark):
    df = spark.createDataFrame([(174.7762, -41.2865), (173.0, 0.0), (-176.5, -44.0), (166.5, -47.2)],
                               "lon double, lat double")
    p = geo.with_nztm(df, "lon", "lat", "x", "y")
    b = geo.with_lonlat(p, "x", "y", "lon2", "lat2").collect()
    assert abs(b[0].x - 1748735.553) < 0.01 and abs(b[0].y - 5427916.479) < 0.01
    assert abs(b[1].x - 1600000.0) < 1e-6 and abs(b[1].y - 10000000.0) < 1e-6
    for r in b:
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8


def test_point_in_polygon_boundary_hole_multipart(spark):
    wkt = "MULTIPOLYGON(((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2)),((20 20,22 20,22 22,20 22,20 20)))"
    g = spark.createDataFrame([(wkt,)], "w string").select(geo.geom_from_wkt("w").alias("geom"))
    g = g.select("geom", geo.edges("geom").alias("edges"), geo.area("geom").alias("a"))
    pts = spark.createDataFrame([(5.0, 5.0), (3.0, 3.0), (0.0, 5.0), (10.0, 10.0), (21.0, 21.0), (15.0, 15.0)],
                                "px double, py double")
    r = pts.join(g).select("px", "py", "a", geo.point_within("px", "py").alias("w"),
                          geo.point_intersects("px", "py").alias("i")).orderBy("px", "py").collect()
    res = {(x.px, x.py): (x.w, x.i) for x in r}
    assert res[(5.0, 5.0)] == (True, True)
    assert res[(3.0, 3.0)] == (False, False)      # in the hole
    assert res[(0.0, 5.0)] == (False, True)       # on the edge
    assert res[(10.0, 10.0)] == (False, True)     # on a vertex
    assert res[(21.0, 21.0)] == (True, True)      # second part
    assert res[(15.0, 15.0)] == (False, False)
    assert r[0].a == 100 - 4 + 4


def test_point_on_surface_inside_concave(spark):
    wkt = "POLYGON((0 0,10 0,10 10,8 10,8 2,2 2,2 10,0 10,0 0))"  # U shape
    g = spark.createDataFrame([(wkt,)], "w string").select(geo.geom_from_wkt("w").alias("geom"))
    g = g.select(geo.point_on_surface("geom").alias("p"), geo.edges("geom").alias("edges"))
    r = g.select(F.col("p.x").alias("px"), F.col("p.y").alias("py"), "edges").select(
        geo.point_within("px", "py").alias("w")).first()
    assert r.w is True


def test_largest_part_and_flip(spark):
    wkt = "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((0 0,4 0,4 4,0 0)))"
    g = spark.createDataFrame([(wkt,)], "w string").select(geo.geom_from_wkt("w").alias("geom"))
    r = g.select(geo.area("geom").alias("a"),
                 geo.largest_part("geom").alias("lp")).first()
    assert len(r.lp) == 1 and r.lp[0][0][1].x == 4.0
    f = g.select(geo.flip_coordinates("geom").alias("f")).first().f
    assert f[1][0][1].x == 0.0 and f[1][0][1].y == 4.0
    assert math.isclose(r.a, 0.5 + 8.0)


def test_centroid_query_variants_and_abbreviations(spark):
    from addrgrid.operators import centroids
    ab = spark.createDataFrame([("St", "Saint", "prefix"), ("Mt", "Mount", "prefix"), ("Rd", "Road", "other")],
                               "short_form string, long_form string, category string")
    s = spark.createDataFrame([
        ("1", "City Centre", "Dunedin City", "Otago"),
        ("2", "Mt Eden", "Manukau City", "Auckland"),
        ("3", "Oneroa", "Waiheke Island", "Auckland"),
        ("4", "Stanmore Rd", "Christchurch City", "Canterbury"),
    ], "suburb_id string, name string, district_name string, region_name string")
    s = s.withColumn("expanded", text.expand_abbreviations("name", ab))
    v = {}
    for r in centroids.query_variants(s).collect():
        v.setdefault(r.suburb_id, []).append((r.rank, r.query_text))
    assert v["1"] == [(1, "Dunedin City, New Zealand"), (3, "City Centre, Dunedin, New Zealand"),
                      (6, "City Centre, Otago, New Zealand")]
    assert v["2"] == [(1, "Mt Eden, Manukau City, New Zealand"), (2, "Mount Eden, Manukau City, New Zealand"),
                      (3, "Mount Eden, Manukau, New Zealand"), (5, "Mount Eden, Auckland, New Zealand"),
                      (6, "Mount Eden, Auckland, New Zealand")]
    assert v["3"][1] == (4, "Oneroa, Waiheke, New Zealand")
    # word-bounded: "Stanmore" keeps its "St"; "Rd" is not a prefix/location entry
    assert v["4"][0] == (1, "Stanmore Rd, Christchurch City, New Zealand")
    assert all(q != "Saintanmore" for _, q in v["4"])


def test_integers_with_many_leading_zeros(spark):
    rows = [("0000000000000061", 61), ("-000000000000000007", -7), ("2147483648", None), ("00002147483647", 2147483647),
            ("+5", 5), ("12a", None)]
    d = spark.createDataFrame(rows, "t string, want int").select(text.parse_int("t").alias("got"), "want")
    assert [r.got for r in d.collect()] == [w for _, w in rows]


def test_escaped_backslashes_do_not_abort_the_batch(spark):
    rows = [(r"a\b", r"a\\b"), (r"a\b", r"A\\B"), ("ab", r"a\b"), ("a%b", r"a\%b"), ("axb", r"a\%b"), ("plain", "lai")]
    d = spark.createDataFrame(rows, "t string, p string").select(text.contains_ci("t", "p").alias("c"))
    assert [r.c for r in d.collect()] == [True, True, True, True, False, True]
