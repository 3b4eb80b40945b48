"""Registered queries of loads, file scans, stored tables, constraints and
samples, over data derived from the given tables, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import hierarchy, load, localities, quality, reports
from ..operators.abbreviations import with_expanded
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import readers, schemas, versions
from ..sources.tables import table
from . import catalog
from .oracle import ORACLE as VIEWS
from .oracle import with_fx

# ---------------------------------------------------------------------------
# shapes: an L with a square hole and a second part, one for each supplier
# ---------------------------------------------------------------------------
SIDE = 30000.0
L_SHELL = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)]
L_HOLE = [(0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.1, 0.3)]
L_OTHER = [(2.0, 0.0), (2.25, 0.0), (2.25, 0.25), (2.0, 0.25)]
#: the same as rectangles that are added or taken away: x0, y0, x1, y1, sign
L_RECTANGLES = [(0.0, 0.0, 1.0, 0.5, 1), (0.0, 0.5, 0.5, 1.0, 1), (0.1, 0.1, 0.3, 0.3, -1), (2.0, 0.0, 2.25, 0.25, 1)]


def _ring(rows):
    return F.array(*[F.struct((F.col("x0") + SIDE * x).alias("x"), (F.col("y0") + SIDE * y).alias("y")) for x, y in [*rows, rows[0]]])


def _shapes(spark, d) -> DataFrame:
    """id, name, name_ascii, major_name, geom; some ids, names and geometries
    are null, some rows repeat an id, every 19th lies off all districts."""
    k = F.col("s_suppkey")
    x0 = (F.lit(1100000.0) + F.lit(900000.0) * (((k * 7919 + 104729) % 1000003) / F.lit(1000003.0))
          + F.when(k % 19 == 7, F.lit(5000000.0)).otherwise(F.lit(0.0)))
    y0 = F.lit(4750000.0) + F.lit(1400000.0) * (((k * 6271 + 15485863) % 999983) / F.lit(999983.0))
    s = table(spark, d, "supplier").select("s_suppkey", x0.alias("x0"), y0.alias("y0"))
    name = F.concat(F.lit("Pōneke "), k.cast("string"))
    s = s.select(F.when(k % 17 != 5, k.cast("string")).alias("id"), name.alias("name"),
                 F.when(k % 3 == 0, F.concat(F.lit("Poneke feed "), k.cast("string"))).alias("name_ascii"),
                 F.when(k % 4 == 0, F.lit("Major")).alias("major_name"),
                 F.when(k % 13 != 4, F.array(F.array(_ring(L_SHELL), _ring(L_HOLE)), F.array(_ring(L_OTHER)))).alias("geom"))
    return s.unionByName(s.where(F.col("id") % 10 == 1).withColumn("name", F.concat(F.lit("ZZ "), "name")))


def load_suburbs_overlap(spark, d):
    out = load.load_suburbs_by_overlap(_shapes(spark, d), fx.districts(spark, d))
    return out.select("suburb_id", "district_id", "name", "name_ascii", "major_name", F.round(geo.area("geom"), 0).alias("area"))


def load_districts_overlap(spark, d):
    out = load.load_districts_by_overlap(_shapes(spark, d), fx.regions(spark, d))
    return out.select("district_id", "region_id", "name", F.round(geo.area("geom"), 0).alias("area"))


def polygon_centroid(spark, d):
    """I16 over every shape, every suburb and every district."""
    shapes = _shapes(spark, d).where("geom is not null and id is not null and name not like 'ZZ%'").select(
        F.lit("shape").alias("kind"), "id", "geom")
    subs = fx.suburbs(spark, d).select(F.lit("suburb").alias("kind"), F.col("suburb_id").alias("id"), "geom")
    dists = fx.districts(spark, d).select(F.lit("district").alias("kind"), F.col("district_id").alias("id"), "geom")
    every = shapes.unionByName(subs).unionByName(dists).select("kind", "id", geo.centroid("geom").alias("c"))
    return every.select("kind", "id", F.round("c.x", 1).alias("x"), F.round("c.y", 1).alias("y"))


# ---------------------------------------------------------------------------
# abbreviations
# ---------------------------------------------------------------------------
def abbreviation_expansion(spark, d):
    """H4: every address of the feed with a dictionary that grows with the suppliers."""
    k = F.col("s_suppkey") % 97
    own = table(spark, d, "supplier").select(
        F.concat(F.lit("Locality "), k.cast("string")).alias("short_form"),
        F.when(k % 3 == 0, F.lit("Mt Rata")).when(k % 3 == 1, F.lit("St Tui")).otherwise(F.concat(F.lit("Loc "), k.cast("string"))).alias("long_form"),
        F.when(k % 5 == 4, F.lit("other")).otherwise(F.lit("location")).alias("category")).distinct()
    fixed = readers.literal_rows(spark, [("Mt", "Mount", "prefix"), ("St", "Saint", "prefix"), ("Rata", "Red Tree", "location")],
                                 schemas.ABBREVIATIONS)
    names = fx.address_feed(spark, d).select("address_id", "full_address")
    return with_expanded(names, "full_address", own.unionByName(fixed)).select("address_id", "expanded")


# ---------------------------------------------------------------------------
# file scans: written from the tables by the library's sinks, read by its readers
# ---------------------------------------------------------------------------
def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan_address_feed(spark, d):
    """A1, A5: the feed as CSV with its 36 columns, read with the declared schema."""
    feed = fx.address_feed(spark, d)
    of = {f.name: (F.col(f.name) if f.name in feed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ADDRESS_FEED}
    path = _folder(spark, "feed")
    readers.write_csv(feed.select(*of.values()), path)
    return readers.read_address_feed(spark, path).select("address_id", "full_address", "address_number", "gd2000_xcoord", "address_lifecycle")


def _wkt(spark, d) -> DataFrame:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda v: F.concat(
        v["x"].cast("decimal(20,3)").cast("string"), F.lit(" "), v["y"].cast("decimal(20,3)").cast("string"))), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return _shapes(spark, d).where("id is not null").select(
        "id", "name", "name_ascii", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform("geom", part), ", "), F.lit(")")).alias("WKT"))


def scan_boundaries(spark, d):
    """A2, A3: boundaries as CSV with WKT, parsed to geometry."""
    path = _folder(spark, "boundaries")
    readers.write_csv(_wkt(spark, d), path)
    b = readers.read_boundaries(spark, path)
    return b.select("id", "name", "geom_type", F.size("geom").alias("parts"), F.round(geo.area("geom"), 0).alias("area"))


def _locality_texts(spark, d) -> DataFrame:
    """One document per supplier: one to three aggregate elements, then its region."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    node = schemas.REGION_NODE["Districts"].dataType
    sub = F.struct(F.col("s_suppkey").cast("int").alias("SuburbId"), F.col("s_name").alias("Name"))
    dist = F.struct(F.col("n_nationkey").cast("int").alias("DistrictId"), F.col("n_name").alias("Name"),
                    F.when(F.col("s_suppkey") % 9 != 4, F.array(sub)).alias("Suburbs"))
    every = F.struct(F.lit("All").alias("Name"), F.lit(None).cast(node).alias("Districts"))
    own = F.array(F.struct(F.col("r_name").alias("Name"), F.array(dist).cast(node).alias("Districts")))
    return j.select(F.to_json(F.concat(F.array_repeat(every, (F.col("s_suppkey") % 3 + 1).cast("int")), own)).alias("value"))


#: files that one task writes, about
FILES_A_TASK = 250


def scan_locality_json(spark, d):
    """Documents as files, regions numbered by their place."""
    path = _folder(spark, "localities")
    texts = _locality_texts(spark, d)
    # a file holds one document: as many files as documents, written and committed by as many tasks as they need
    tasks = texts.count() // FILES_A_TASK + 1
    (texts.select("value").repartition(tasks).write.option("maxRecordsPerFile", 1)
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))
    return localities.regions_from_documents(readers.read_locality_json(spark, path)).groupBy("region_id", "name").agg(
        F.count("*").alias("documents"))


def scan_listings(spark, d):
    """Listings as CSV."""
    s = table(spark, d, "supplier").select(F.lit("R").alias("region"), F.concat(F.lit("d, "), F.col("s_nationkey").cast("string")).alias("district"),
                                           F.concat(F.lit('the "'), "s_name", F.lit('"')).alias("suburb"))
    path = _folder(spark, "listings")
    readers.write_csv(s, path)
    return readers.read_listings(spark, path)


def extract_hierarchy_report(spark, d):
    """Known and unknown regions of the documents in one pass."""
    docs = _locality_texts(spark, d).select(F.from_json("value", schemas.LOCALITY_JSON).alias("doc"))
    known = table(spark, d, "region").where("r_regionkey <> 4").select(
        F.col("r_name").alias("name"), text.format_id("R", 2, F.col("r_regionkey") + 1).alias("region_id"))
    return localities.hierarchy_report(docs, known)


# ---------------------------------------------------------------------------
# stored tables
# ---------------------------------------------------------------------------
def safe_repopulate(spark, d):
    """A10: the streets table filled, then replaced by a job that reads it."""
    root = _folder(spark, "streets")
    feed = fx.address_feed(spark, d).select(F.col("suburb_locality").alias("suburb"), text.to_ascii("full_road_name").alias("street"), "address_id")
    versions.publish(feed.where("address_id % 2 = 0").select("suburb", "street").distinct(), root)
    old = versions.current(spark, root)
    versions.publish(old.unionByName(feed.where("address_id % 3 = 0").select("suburb", "street")).distinct(), root)
    return versions.current(spark, root)


def update_centroids(spark, d):
    """Suburbs with the centroids of every second one set, defaults and load time."""
    root = _folder(spark, "suburbs")
    subs = fx.suburbs(spark, d).select("suburb_id", "name", F.lit(None).cast("double").alias("centroid_x"),
                                       F.when(F.col("suburb_id") % 5 == 0, F.lit("feed")).alias("source"), "geom")
    versions.publish(versions.with_defaults(subs.drop("geom"), {"source": "trademe", "is_primary": False}), root)
    found = subs.where("suburb_id % 2 = 0").select("suburb_id", geo.centroid("geom")["x"].alias("centroid_x"))
    found = found.unionByName(found.limit(1).select(F.lit("no such suburb").alias("suburb_id"), "centroid_x"))
    versions.publish(versions.keyed_update(versions.current(spark, root), found, "suburb_id", ["centroid_x"]), root)
    return versions.current(spark, root).select(
        "suburb_id", "name", F.round("centroid_x", 1).alias("centroid_x"), "source", "is_primary",
        F.col("created_at").isNotNull().alias("has_created_at"))


# ---------------------------------------------------------------------------
# constraints, geometry types, samples
# ---------------------------------------------------------------------------
def constraint_violations(spark, d):
    """C17 on all five tables, with violations planted in suburbs, addresses and streets."""
    k = F.col("suburb_id").cast("long")
    subs = fx.suburbs(spark, d).select("suburb_id", F.when(k % 23 == 0, None).when(k % 29 == 0, "999").otherwise(F.col("district_id")).alias("district_id"),
                                       F.when(k % 11 != 3, F.col("name")).alias("name"))
    subs = subs.unionByName(subs.where("suburb_id % 31 = 0"))
    addresses = fx.address_feed(spark, d).select(F.when(F.col("address_id") % 701 != 0, F.col("address_id")).alias("address_id"))
    addresses = addresses.unionByName(addresses.where("address_id % 499 = 0"))
    streets = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("suburb_id"),
                                                 F.when(F.col("s_suppkey") % 37 != 0, F.col("s_name")).alias("street_name"))
    streets = streets.unionByName(streets.where("suburb_id % 41 = 0")).unionByName(
        streets.where("suburb_id % 43 = 0").withColumn("suburb_id", F.concat(F.lit("x"), "suburb_id")))
    tables = {"regions": fx.regions(spark, d).select("region_id", "name"), "districts": fx.districts(spark, d).select("district_id", "region_id", "name"),
              "suburbs": subs, "addresses": addresses, "streets": streets}
    c = quality.Constraints
    return quality.violations(tables, {
        "regions": c(["region_id"], ["name"]),
        "districts": c(["district_id"], ["region_id", "name"], [("region_id", "regions", "region_id")]),
        "suburbs": c(["suburb_id"], ["district_id", "name"], [("district_id", "districts", "district_id")]),
        "addresses": c(["address_id"], ["address_id"]),
        "streets": c(["suburb_id", "street_name"], ["suburb_id", "street_name"], [("suburb_id", "suburbs", "suburb_id")])})


def _typed(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    wkt = (F.when(k % 7 == 0, F.lit("POINT (1 2)")).when(k % 7 == 1, F.lit("  polygon ((0 0, 1 0, 1 1, 0 0))"))
           .when(k % 7 == 2, F.lit("LINESTRING (0 0, 1 1)")).when(k % 7 == 3, F.lit(None).cast("string")).when(k % 7 == 4, F.lit(" "))
           .when(k % 7 == 5, F.lit("POLYGON 5")).otherwise(F.lit("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)))")))
    return table(spark, d, "supplier").select(k.cast("string").alias("id"), wkt.alias("shape"))


def geometry_quarantine(spark, d):
    """Both sides of the split."""
    good, bad = quality.split_by_geometry(_typed(spark, d), "shape", ("POLYGON", "MULTIPOLYGON"))
    good = good.withColumn("g", geo.geom_from_wkt("shape"))
    return good.select("id", "geom_type", F.lit(None).cast("string").alias("reason"), geo.area("g").alias("area")).unionByName(
        bad.select("id", "geom_type", "reason", F.lit(None).cast("double").alias("area")))


def locality_samples(spark, d):
    """Listings that partly match the suburbs' names."""
    k = F.col("s_suppkey")
    listed = table(spark, d, "supplier").select(
        F.when(k % 3 == 0, F.concat(F.lit("listed-"), k.cast("string"))).otherwise(F.concat(F.lit("LOCALITY-"), ((k * 7) % 97).cast("string"))).alias("suburb"))
    return reports.locality_samples(listed, fx.suburbs(spark, d).select("name"))


# ---------------------------------------------------------------------------
# request-shaped browse calls: the children of many requested parents, each
# row with its place in the answer to its parent
# ---------------------------------------------------------------------------
def _placed_rows(df: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))


def browse_regions_call(spark, d):
    """J7 regions(): by name."""
    return _placed_rows(hierarchy.browse_regions(catalog.regions_browse(spark, d)).withColumn("_all", F.lit(1)), ["_all"],
                        ["name", "region_id"]).drop("_all")


def browse_districts_call(spark, d):
    """J7 districts(region): by display name, for every second region."""
    asked = fx.regions(spark, d).where("region_id % 2 = 1").select("region_id")
    return _placed_rows(hierarchy.browse_districts(catalog.districts_browse(spark, d), asked), ["region_id"], ["name", "district_id"])


def browse_suburbs_call(spark, d):
    """J7 suburbs(district): by priority and name, for every fifth district."""
    asked = fx.districts(spark, d).where("district_id % 5 = 2").select("district_id")
    rows = hierarchy.browse_suburbs(catalog.suburbs_browse(spark, d), asked)
    return _placed_rows(rows, ["district_id"], ["sort_priority", "name", "suburb_id"]).drop("name_ascii")


def browse_streets_call(spark, d):
    """J7 streets(suburb): by name, for two of three suburbs."""
    asked = fx.suburbs(spark, d).where("suburb_id % 3 <> 1").select("suburb_id")
    return _placed_rows(hierarchy.browse_streets(catalog.streets_by_suburb(spark, d), asked), ["suburb_id"], ["street_name"])


QUERIES = {f.__name__: f for f in (
    browse_regions_call, browse_districts_call, browse_suburbs_call, browse_streets_call,
    load_suburbs_overlap, load_districts_overlap, polygon_centroid, abbreviation_expansion, scan_address_feed, scan_boundaries,
    scan_locality_json, scan_listings, extract_hierarchy_report, safe_repopulate, update_centroids, constraint_violations,
    geometry_quarantine, locality_samples)}

# ---------------------------------------------------------------------------
# DuckDB
# ---------------------------------------------------------------------------
_SHAPE = """select *, case when k % 13 <> 4 then true else false end has_geom from (
select s_suppkey k, case when s_suppkey % 17 <> 5 then cast(s_suppkey as varchar) end id, 'Pōneke ' || s_suppkey as name,
  case when s_suppkey % 3 = 0 then 'Poneke feed ' || s_suppkey end name_ascii, case when s_suppkey % 4 = 0 then 'Major' end major_name,
  1100000.0e0 + 900000.0e0*(((s_suppkey*7919+104729)%1000003)/1000003.0e0) + case when s_suppkey % 19 = 7 then 5000000.0e0 else 0.0e0 end x0,
  4750000.0e0 + 1400000.0e0*(((s_suppkey*6271+15485863)%999983)/999983.0e0) y0
from supplier)"""
_RECTS = "select * from (values " + ",".join(str(r) for r in L_RECTANGLES) + ") r(a0,b0,a1,b1,sgn)"
_PLACED = (f"select s.id, x0+{SIDE}*a0 px0, y0+{SIDE}*b0 py0, x0+{SIDE}*a1 px1, y0+{SIDE}*b1 py1, sgn from shape s, rect "
           "where id is not null and has_geom")


def _best(parent: str, key: str) -> str:
    return (f"select id, {key} from (select r.id, p.{key}, sum(sgn * greatest(0.0e0, least(px1, maxx) - greatest(px0, minx)) * "
            f"greatest(0.0e0, least(py1, maxy) - greatest(py0, miny))) o from placed r, {parent} p group by 1, 2) where o > 1e-3 "
            f"qualify row_number() over (partition by id order by o desc, {key}) = 1")


_AREA = sum(sgn * (a1 - a0) * (b1 - b0) for a0, b0, a1, b1, sgn in L_RECTANGLES) * SIDE * SIDE
_SHAPES = [("shape", _SHAPE), ("rect", _RECTS), ("placed", _PLACED)]


def _centroid_sql(vertex: str, key: str, kind: str) -> str:
    return (f"select '{kind}' kind, {key} id, sum((x + nx) * c) / (3 * sum(c)) + min(ox) x, sum((y + ny) * c) / (3 * sum(c)) + min(oy) y from ("
            f"select *, x * ny - nx * y c from (select {key}, ox, oy, x - ox x, y - oy y, "
            f"coalesce(lead(x) over w, first_value(x) over w) - ox nx, coalesce(lead(y) over w, first_value(y) over w) - oy ny from ("
            f"select *, first_value(x) over w ox, first_value(y) over w oy from {vertex} window w as (partition by {key} order by seq "
            f"rows between unbounded preceding and unbounded following)) window w as (partition by {key} order by seq "
            f"rows between unbounded preceding and unbounded following))) group by {key}")


_A = sum(sgn * (a1 - a0) * (b1 - b0) for a0, b0, a1, b1, sgn in L_RECTANGLES)
_CX, _CY = (sum(r[4] * (r[2] - r[0]) * (r[3] - r[1]) * (r[i] + r[i + 2]) / 2 for r in L_RECTANGLES) / _A for i in (0, 1))
_JOINED = "supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey"

ORACLE = {
    "load_suburbs_overlap": with_fx(["dis_bbox"], f"""
select s.id suburb_id, b.district_id, s.name, coalesce(s.name_ascii, replace(s.name, 'ō', 'o')) name_ascii, s.major_name,
  round({_AREA!r}, 0) area from shape s left join best b on b.id = s.id where s.id is not null and has_geom""",
                                    [*_SHAPES, ("best", _best("dis_bbox", "district_id"))]),
    "load_districts_overlap": with_fx(["reg_bbox"], f"""
select s.id district_id, b.region_id, s.name, round({_AREA!r}, 0) area from shape s left join best b on b.id = s.id
where s.id is not null and has_geom""", [*_SHAPES, ("best", _best("reg_bbox", "region_id"))]),
    "polygon_centroid": with_fx(["fx_suburb_vertex", "fx_district_vertex"], f"""
select kind, id, round(x, 1) x, round(y, 1) y from (
select 'shape' kind, id, x0 + {SIDE * _CX!r} x, y0 + {SIDE * _CY!r} y from shape where id is not null and has_geom
union all {_centroid_sql('fx_suburb_vertex', 'suburb_id', 'suburb')}
union all {_centroid_sql('fx_district_vertex', 'district_id', 'district')})""", _SHAPES[:1]),
    "abbreviation_expansion": with_fx(["fx_address"], """
select address_id, t expanded from steps where n = (select max(n) from dict)""", [
        ("dict", """select row_number() over (order by -length(s), s) n, s, l from (select distinct 'Locality ' || (s_suppkey % 97) s,
  case when s_suppkey % 97 % 3 = 0 then 'Mt Rata' when s_suppkey % 97 % 3 = 1 then 'St Tui' else 'Loc ' || (s_suppkey % 97) end l
  from supplier where s_suppkey % 97 % 5 <> 4 union all values ('Mt', 'Mount'), ('St', 'Saint'), ('Rata', 'Red Tree'))"""),
        ("steps", r"""select address_id, 0::bigint n, full_address t from fx_address union all
  select p.address_id, d.n, regexp_replace(p.t, '\b' || d.s || '\b', d.l, 'g') from steps p join dict d on d.n = p.n + 1"""),
    ]).replace("WITH ", "WITH RECURSIVE ", 1),
    "scan_address_feed": with_fx(["fx_address"], """
select address_id, full_address, address_number, x_coord gd2000_xcoord, address_lifecycle from fx_address"""),
    "scan_boundaries": with_fx([], f"""
select id, name, case when has_geom then 'MULTIPOLYGON' end geom_type, case when has_geom then 2 end parts,
  case when has_geom then round({_AREA!r}, 0) end area from (select * from shape where id is not null union all
  select * replace ('ZZ ' || name as name) from shape where id is not null and k % 10 = 1)""", _SHAPES[:1]),
    "scan_locality_json": f"""
select printf('R%02d', 2 + s_suppkey % 3) region_id, r_name as name, count(*) documents from {_JOINED} group by 1, 2""",
    "scan_listings": """select 'R' region, 'd, ' || s_nationkey district, 'the "' || s_name || '"' suburb from supplier""",
    "extract_hierarchy_report": f"""
select r_name region_name, case when r_regionkey <> 4 then printf('R%02d', r_regionkey + 1) end region_id, count(*) districts,
  count(*) filter (where s_suppkey % 9 <> 4) suburbs, r_regionkey <> 4 known from {_JOINED} group by r_name, r_regionkey""",
    "safe_repopulate": with_fx(["fx_address"], """
select distinct suburb_locality suburb, translate(full_road_name, 'āēīōūĀĒĪŌŪ', 'aeiouAEIOU') street from fx_address
where address_id % 2 = 0 or address_id % 3 = 0"""),
    "update_centroids": with_fx(["fx_suburb", "fx_suburb_vertex"], f"""
select s.suburb_id, s.name, case when cast(s.suburb_id as bigint) % 2 = 0 then round(c.x, 1) end centroid_x,
  case when cast(s.suburb_id as bigint) % 5 = 0 then 'feed' else 'trademe' end source, false is_primary, true has_created_at
from fx_suburb s join ({_centroid_sql('fx_suburb_vertex', 'suburb_id', 'suburb')}) c on c.id = s.suburb_id"""),
    "constraint_violations": with_fx(["fx_suburb", "fx_address"], """
select 'suburbs' table_name, 'not_null:district_id' rule, suburb_id as key, count(*) as rows from sub2 where district_id is null group by 3
union all select 'suburbs', 'not_null:name', suburb_id, count(*) from sub2 where name is null group by 3
union all select 'suburbs', 'unique:suburb_id', suburb_id, count(*) from sub2 group by 3 having count(*) > 1
union all select 'suburbs', 'foreign:district_id', suburb_id, count(*) from sub2 where district_id = '999' group by 3
union all select 'addresses', 'not_null:address_id', '(null)', count(*) from fx_address where address_id % 701 = 0 having count(*) > 0
union all select 'addresses', 'unique:address_id', cast(address_id as varchar), 2 from fx_address where address_id % 499 = 0 and address_id % 701 <> 0
union all select 'streets', 'not_null:street_name', suburb_id || '|(null)', count(*) from st2 where street_name is null group by 3
union all select 'streets', 'unique:suburb_id,street_name', suburb_id || '|' || street_name, count(*) from st2 where street_name is not null
  group by 3 having count(*) > 1
union all select 'streets', 'foreign:suburb_id', suburb_id || '|' || coalesce(street_name, '(null)'), count(*) from st2
  where suburb_id not in (select suburb_id from fx_suburb) group by 3""", [
        ("sub1", """select suburb_id, case when cast(suburb_id as bigint) % 23 = 0 then null when cast(suburb_id as bigint) % 29 = 0 then '999'
  else district_id end district_id, case when cast(suburb_id as bigint) % 11 <> 3 then name end as name from fx_suburb"""),
        ("sub2", "select * from sub1 union all select * from sub1 where cast(suburb_id as bigint) % 31 = 0"),
        ("st1", "select cast(s_suppkey as varchar) suburb_id, case when s_suppkey % 37 <> 0 then s_name end street_name, s_suppkey k from supplier"),
        ("st2", "select suburb_id, street_name from st1 union all select suburb_id, street_name from st1 where k % 41 = 0 "
                "union all select 'x' || suburb_id, street_name from st1 where k % 43 = 0"),
    ]),
    "geometry_quarantine": """
select cast(s_suppkey as varchar) id,
  case s_suppkey % 7 when 0 then 'POINT' when 1 then 'POLYGON' when 2 then 'LINESTRING' when 5 then 'POLYGON' when 6 then 'MULTIPOLYGON' end geom_type,
  case s_suppkey % 7 when 0 then 'type POINT' when 2 then 'type LINESTRING' when 3 then 'no geometry' when 4 then 'no geometry'
    when 5 then 'not a geometry' end reason,
  case s_suppkey % 7 when 1 then 0.5e0 when 6 then 2.0e0 end area from supplier""",
    "locality_samples": with_fx(["fx_suburb"], """
select section, ord, name from (select *, row_number() over (partition by section order by name) ord from (
select case when l.k is not null and s.k is not null then 'in both' when l.k is not null then 'only in listings' else 'only in reference' end section,
  coalesce(l.k, s.k) as name from (select distinct case when s_suppkey % 3 = 0 then 'listed ' || s_suppkey
  else 'locality ' || ((s_suppkey * 7) % 97) end k from supplier) l full join (select distinct lower(trim(name)) k from fx_suburb) s on l.k = s.k)) where ord <= 30"""),
}
ORACLE |= {
    "browse_regions_call": f"""
select region_id, name, district_count, row_number() over (order by name, region_id) place from ({VIEWS["regions_browse"]}) v""",
    "browse_districts_call": f"""
select district_id, region_id, display_name as name, suburb_count,
  row_number() over (partition by region_id order by display_name, district_id) place
from ({VIEWS["districts_browse"]}) v where cast(region_id as bigint) % 2 = 1""",
    "browse_suburbs_call": f"""
select suburb_id, district_id, name, name major_name, street_count, is_major_suburb, population_category, sort_priority,
  row_number() over (partition by district_id order by sort_priority, name, suburb_id) place
from ({VIEWS["suburbs_browse"]}) v where cast(district_id as bigint) % 5 = 2""",
    "browse_streets_call": f"""
select suburb_id, street_name, row_number() over (partition by suburb_id order by street_name) place
from ({VIEWS["streets_by_suburb"]}) v where cast(suburb_id as bigint) % 3 <> 1""",
}
