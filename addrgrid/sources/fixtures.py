"""Test inputs derived from the driver tables (FIXTURES.md section 4).

Roles: region -> region, nation -> district, supplier -> suburb,
orders -> address points / address feed, customer -> raw requests.
Every fixture is a DataFrame derived from the given tables, so its size
grows with the scale factor. Vertex offsets are generated per row with
``explode`` of a literal array (no join).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .tables import table

# ---------------------------------------------------------------------------
# Fixed fixture values (same text as the DuckDB oracle in plans/oracle.py)
# ---------------------------------------------------------------------------
RECT_OFFSETS = [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)]
SUBURB_OFFSETS = [(0, 5, 50), (1, 30, 5), (2, 75, 10), (3, 95, 55), (4, 60, 95), (5, 45, 60), (6, 15, 90)]
ROAD_BASES = ["Kōwhai", "Rata", "Mānuka", "Tui", "Hill", "Harbour View", "Pōhutukawa", "Mill",
              "Bridge", "Spring", "Totara", "Beach", "Station", "Ngāio"]
ROAD_TYPES = ["Street", "Road", "Avenue", "Lane", "Way"]
TOWNS = ["Northport", "Ōwaka Bay", "Westfield", "Lake Town", "Eastmoor"]
SUBURB_NAMES = ["Ponsonby", "Mt Eden", "St Heliers", "Karori", "Green Bay", "Te Aro"]
MAJOR_NAMES = ["Ponsonby", "Karori", "Mt Eden"]


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _offsets(rows) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(float(a)).alias("ox"),
                                        F.lit(float(b)).alias("oy")) for s, a, b in rows]))


def region_vertices(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey", "r_name", _offsets(RECT_OFFSETS).alias("v"))
    return r.select(F.col("r_regionkey").cast("string").alias("region_id"), F.col("v.seq").alias("seq"),
                    (F.lit(1100000.0) + F.lit(200000.0) * (F.col("r_regionkey") + F.col("v.ox"))).alias("x"),
                    (F.lit(4750000.0) + F.lit(1450000.0) * F.col("v.oy")).alias("y"))


def district_vertices(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", _offsets(RECT_OFFSETS).alias("v"))
    k = F.col("n_nationkey")
    return n.select(k.cast("string").alias("district_id"), F.col("v.seq").alias("seq"),
                    (F.lit(1100000.0) + F.lit(200000.0) * ((k % 5) + F.col("v.ox"))).alias("x"),
                    (F.lit(4750000.0) + F.lit(290000.0) * (F.floor(k / 5) + F.col("v.oy"))).alias("y"))


def suburb_grid(spark: SparkSession, d: str) -> int:
    """Cells on a side of a district: the smallest square that gives every
    supplier key a cell of its own, 10 at least."""
    top = table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] or 0
    return max(10, math.isqrt(top) + 1)


def suburb_cells(spark: SparkSession, d: str) -> DataFrame:
    """One suburb per supplier, in the cell of its key within its nation."""
    n = suburb_grid(spark, d)
    k = F.col("s_suppkey")
    g = table(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("nk"), (k % n).alias("gx"),
                                           F.floor(k / n).cast("long").alias("gy"), F.lit(n).alias("grid"))
    k = F.col("k")
    name = F.when(k % 4 == 3, _pick(SUBURB_NAMES, F.floor(k / 4) % 6)).otherwise(
        F.concat(F.lit("Locality "), (k % 97).cast("string")))
    major = F.when(k % 5 == 0, F.lit("Northport")).when(k % 5 == 1, F.lit(""))
    return g.select(k.cast("string").alias("suburb_id"), F.col("nk").cast("string").alias("district_id"),
                    "nk", "gx", "gy", "grid", name.alias("name"), major.alias("major_name"))


def suburb_vertices(spark: SparkSession, d: str) -> DataFrame:
    c = suburb_cells(spark, d).select("suburb_id", "nk", "gx", "gy", "grid", _offsets(SUBURB_OFFSETS).alias("v"))
    return c.select("suburb_id", F.col("v.seq").alias("seq"),
                    (F.lit(1100000.0) + F.lit(200000.0) * (F.col("nk") % 5)
                     + F.lit(200000.0) / F.col("grid") * (F.col("gx") + F.col("v.ox") / F.lit(100.0))).alias("x"),
                    (F.lit(4750000.0) + F.lit(290000.0) * F.floor(F.col("nk") / 5)
                     + F.lit(290000.0) / F.col("grid") * (F.col("gy") + F.col("v.oy") / F.lit(100.0))).alias("y"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """regions(region_id, code, name, geom)."""
    g = geo.polygons_from_vertices(region_vertices(spark, d), "region_id")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("region_id"),
                                         F.col("r_name").alias("name"))
    return r.join(g, "region_id", "left").select(
        "region_id", geo_code("R", 2, "region_id").alias("code"), "name", "geom")


def geo_code(prefix, width, c) -> Column:
    return F.format_string(f"{prefix}%0{width}d", F.col(c).cast("int"))


def districts(spark: SparkSession, d: str) -> DataFrame:
    """districts(district_id, region_id, code, name, geom)."""
    g = geo.polygons_from_vertices(district_vertices(spark, d), "district_id")
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("district_id"),
        F.col("n_regionkey").cast("string").alias("region_id"), F.col("n_name").alias("name"))
    return n.join(g, "district_id", "left").select(
        "district_id", "region_id", geo_code("D", 4, "district_id").alias("code"), "name", "geom")


def suburbs(spark: SparkSession, d: str) -> DataFrame:
    """suburbs(suburb_id, district_id, name, major_name, geom)."""
    g = geo.polygons_from_vertices(suburb_vertices(spark, d), "suburb_id")
    c = suburb_cells(spark, d).select("suburb_id", "district_id", "name", "major_name")
    return c.join(g, "suburb_id", "left")


def points(spark: SparkSession, d: str) -> DataFrame:
    """fx_point: metric-plane points, one per order."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("address_id"),
        (F.lit(1100000.0) + F.lit(1000000.0) * (((k * 7919 + 104729) % 1000003) / F.lit(1000003.0))).alias("x"),
        (F.lit(4750000.0) + F.lit(1450000.0) * (((k * 6271 + 15485863) % 999983) / F.lit(999983.0))).alias("y"))


def address_feed(spark: SparkSession, d: str) -> DataFrame:
    """fx_address in the address-feed column names (A1 schema subset)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    base = _pick(ROAD_BASES, (k * 31 + 7) % 14)
    rt = _pick(ROAD_TYPES, (k * 17 + 3) % 5)
    town = _pick(TOWNS, k % 5)
    num = (k % 120 + 1).cast("int")
    road = F.concat(base, F.lit(" "), rt)
    loc = F.concat(F.lit("Locality "), (F.col("o_custkey") % 97).cast("string"))
    lon = F.when(k % 53 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(166.5) + F.lit(12.0) * (((k * 7919 + 104729) % 1000003) / F.lit(1000003.0)))
    lat = F.when(k % 53 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(-47.2) + F.lit(12.8) * (((k * 6271 + 15485863) % 999983) / F.lit(999983.0)))
    null = F.lit(None).cast("string")
    return o.select(
        k.alias("address_id"), num.alias("address_number"), road.alias("full_road_name"),
        loc.alias("suburb_locality"), town.alias("town_city"),
        F.concat(num.cast("string"), F.lit(" "), road, F.lit(", "), loc, F.lit(", "), town).alias("full_address"),
        lon.alias("gd2000_xcoord"), lat.alias("gd2000_ycoord"),
        F.when(k % 41 == 0, F.lit("Retired")).otherwise(F.lit("Current")).alias("address_lifecycle"),
        null.alias("full_address_ascii"), null.alias("full_road_name_ascii"),
        null.alias("suburb_locality_ascii"), null.alias("address_number_prefix"),
        null.alias("address_number_suffix"), F.concat(F.lit("District "), (k % 25).cast("string")).alias("territorial_authority"))


def address_count(spark: SparkSession, d: str) -> int:
    """Rows of the address feed (one per order): requests are derived from all of it."""
    return max(1, table(spark, d, "orders").count())


def raw_requests(spark: SparkSession, d: str) -> DataFrame:
    """fx_raw: 8 kinds of free-text request (kind = raw_id % 8)."""
    c = table(spark, d, "customer").select("c_custkey")
    a = address_feed(spark, d).select("address_id", "address_number", "full_road_name", "town_city", "full_address")
    j = c.join(a, F.col("address_id") == (F.col("c_custkey") * 13) % address_count(spark, d))
    num = F.col("address_number").cast("string")
    kind = F.col("c_custkey") % 8
    raw = (F.when(kind == 0, F.col("full_address"))
           .when(kind == 1, F.lower(F.concat(num, F.lit(" "), F.col("full_road_name"))))
           .when(kind == 2, F.concat(num, F.lit(" "), F.split_part(F.col("full_road_name"), F.lit(" "), F.lit(1)),
                                     F.lit(" "), F.col("town_city")))
           .when(kind == 3, F.concat(F.lit("  "), F.upper(F.replace(F.col("full_address"), F.lit(", "), F.lit(",  "))),
                                     F.lit(". ")))
           .when(kind == 4, F.replace(F.col("full_address"), F.concat(num, F.lit(" ")), F.concat(num, F.lit("A "))))
           .when(kind == 5, F.lit("   "))
           .when(kind == 6, num)
           .otherwise(F.concat(F.lit("zzqx "), (F.lit(90000) + F.col("c_custkey")).cast("string"))))
    return j.select(F.col("c_custkey").alias("raw_id"), raw.alias("raw_address"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Coordinate requests (lon/lat degrees), one per customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("point_id"),
        (F.lit(166.5) + F.lit(12.0) * (((k * 4099 + 77) % 100003) / F.lit(100003.0))).alias("lon"),
        (F.lit(-47.2) + F.lit(12.8) * (((k * 2459 + 131) % 99991) / F.lit(99991.0))).alias("lat"))


def autocomplete_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search prefixes/substrings of six kinds (kind = query_id % 6)."""
    c = table(spark, d, "customer").select("c_custkey")
    a = address_feed(spark, d).select("address_id", "address_number", "full_road_name", "suburb_locality")
    j = c.join(a, F.col("address_id") == (F.col("c_custkey") * 7) % address_count(spark, d))
    kind = F.col("c_custkey") % 6
    q = (F.when(kind == 0, F.split_part(F.col("full_road_name"), F.lit(" "), F.lit(1)))
         .when(kind == 1, F.lower(F.col("full_road_name")))
         .when(kind == 2, F.concat(F.col("address_number").cast("string"), F.lit(" "),
                                   F.split_part(F.col("full_road_name"), F.lit(" "), F.lit(1))))
         .when(kind == 3, F.concat(F.lit(" "), F.lower(F.col("suburb_locality"))))
         .when(kind == 4, F.lit("ab"))
         .otherwise(F.concat(F.lit("zq"), (F.col("c_custkey") % 10).cast("string"))))
    return j.select(F.col("c_custkey").alias("query_id"), q.alias("query"))
