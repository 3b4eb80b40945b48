"""Hierarchy: resolve (J6/C13), streets (J5), browse views (J7, L4),
district aliases (J12) and suburb classification (J13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from . import spatial

# ---------------------------------------------------------------------------
# Manual list of major suburb / city names (J13), lower case.
# ---------------------------------------------------------------------------
MAJOR_SUBURBS = (
    "auckland", "manukau", "north shore", "waitakere", "albany", "newmarket",
    "ponsonby", "parnell", "remuera", "mt eden", "epsom", "greenlane",
    "ellerslie", "panmure", "howick", "pakuranga", "botany", "manukau city",
    "takapuna", "devonport", "browns bay", "orewa", "henderson", "new lynn",
    "avondale", "mt albert", "glen innes", "st heliers", "mission bay",
    "wellington", "lower hutt", "upper hutt", "porirua", "kapiti", "paraparaumu",
    "petone", "eastbourne", "johnsonville", "kelburn", "karori", "newtown",
    "christchurch", "riccarton", "fendalton", "merivale", "hornby", "linwood",
    "sumner", "lyttelton", "rangiora", "kaiapoi", "rolleston",
    "hamilton", "tauranga", "napier", "hastings", "new plymouth", "palmerston north",
    "nelson", "queenstown", "dunedin", "invercargill", "rotorua", "gisborne",
    "whangarei", "timaru", "oamaru", "ashburton", "masterton",
)
# Population category display order (D5 report).
CATEGORY_ORDER = ("major", "medium", "minor")


def resolve_hierarchy(points: DataFrame, suburbs: DataFrame, districts: DataFrame,
                      key: str = "point_id", x: str = "x", y: str = "y",
                      suburb_cell: float | None = None, district_cell: float | None = None) -> DataFrame:
    """Point -> (region_id, district_id, suburb_id).

    Containing suburb first (its district, then that district's region);
    points whose suburb gives no district fall back to the containing
    district. Only that residue runs the second spatial join.
    """
    pts = cut_lineage(points.select(key, x, y))
    sub = spatial.first_containing(
        pts, suburbs.select("suburb_id", F.col("district_id").alias("s_district_id"), "geom"),
        key, "suburb_id", x=x, y=y, carry=["s_district_id"], cell=suburb_cell)
    p = cut_lineage(pts.join(sub, key, "left"))
    dims = districts.select(F.col("district_id").alias("_d"), F.col("region_id").alias("_r"))
    with_d = (p.where(F.col("s_district_id").isNotNull())
              .join(dims, F.col("s_district_id") == F.col("_d"), "left")
              .select(key, F.col("_r").alias("region_id"), F.col("s_district_id").alias("district_id"),
                      "suburb_id"))
    rest = p.where(F.col("s_district_id").isNull())
    dist = spatial.first_containing(
        rest.select(key, x, y), districts.select("district_id", "region_id", "geom"),
        key, "district_id", x=x, y=y, carry=["region_id"], cell=district_cell)
    no_d = (rest.select(key, "suburb_id").join(dist, key, "left")
            .select(key, "region_id", "district_id", "suburb_id"))
    return with_d.unionByName(no_d)


def refresh_streets(addresses: DataFrame, suburbs: DataFrame, cell: float | None = None) -> DataFrame:
    """Distinct (suburb_id, street_name) for addresses inside a suburb.

    street_name is the ASCII road name; blanks are dropped before the join so
    they never reach the shuffle.
    """
    a = (addresses.where(F.col("full_road_name_ascii").isNotNull() & (F.col("full_road_name_ascii") != ""))
         .select(F.col("full_road_name_ascii").alias("street_name"), "gx", "gy"))
    pip = spatial.point_in_polygon_join(a, suburbs.select("suburb_id", "geom"), x="gx", y="gy",
                                        cell=cell, keep=["suburb_id"])
    return pip.select("suburb_id", "street_name").distinct()


def regions_view(regions: DataFrame, districts: DataFrame, suburbs: DataFrame) -> DataFrame:
    """v_regions: district_count and suburb_count per region.

    Children are aggregated before the join, so the join never fans out.
    """
    d_cnt = districts.groupBy("region_id").agg(F.countDistinct("district_id").alias("district_count"))
    s_per_d = suburbs.groupBy("district_id").agg(F.countDistinct("suburb_id").alias("_n"))
    s_cnt = (s_per_d.join(districts.select("district_id", "region_id").distinct(), "district_id")
             .groupBy("region_id").agg(F.sum("_n").alias("suburb_count")))
    return (regions.select("region_id", "code", "name")
            .join(d_cnt, "region_id", "left").join(s_cnt, "region_id", "left")
            .select("region_id", "code", "name",
                    F.coalesce("district_count", F.lit(0)).cast("long").alias("district_count"),
                    F.coalesce("suburb_count", F.lit(0)).cast("long").alias("suburb_count")))


def district_aliases(seed: DataFrame, districts: DataFrame, exclude_prefix: str = "076") -> DataFrame:
    """Seed aliases, plus the official name (primary) for every district
    whose id does not start with ``exclude_prefix``.

    alias_id is the serial number in insertion order: seed rows in seed order,
    then districts by id. The alias table is a bounded dimension.
    """
    s = seed.select("district_id", "market_name", "is_primary", F.lit(0).alias("_src"), F.col("seed_ord").alias("_o"))
    o = (districts.where(~F.col("district_id").like(exclude_prefix + "%"))
         .select("district_id", F.col("name").alias("market_name"), F.lit(True).alias("is_primary"),
                 F.lit(1).alias("_src"), F.lit(0).alias("_o")))
    u = s.unionByName(o)
    w = Window.orderBy("_src", "_o", "district_id")
    return u.select(F.row_number().over(w).alias("alias_id"), "district_id", "market_name", "is_primary")


def classify_suburbs(suburbs: DataFrame, major_names=MAJOR_SUBURBS, simple: bool = False) -> DataFrame:
    """population_category / is_major_suburb by the ordered rules.

    Full mode: 'medium' when major_name is set; 'major' (wins) when the lower
    name is in the list; the rest 'minor'. Simple mode: major := major_name is
    not null; medium if so else minor.
    """
    has_major = F.col("major_name").isNotNull() & (F.col("major_name") != "")
    if simple:
        return suburbs.withColumn("is_major_suburb", F.col("major_name").isNotNull()).withColumn(
            "population_category", F.when(F.col("major_name").isNotNull(), "medium").otherwise("minor"))
    in_list = F.lower(F.col("name")).isin(*major_names)
    cat = F.when(in_list, "major").when(has_major, "medium").otherwise("minor")
    return (suburbs.withColumn("population_category", cat)
            .withColumn("is_major_suburb", in_list))


def districts_view(districts: DataFrame, suburbs: DataFrame, aliases: DataFrame) -> DataFrame:
    """v_districts: display name from the primary alias, suburb counts."""
    prim = (aliases.where(F.col("is_primary"))
            .groupBy("district_id").agg(F.min_by("market_name", "alias_id").alias("_alias")))
    cnt = suburbs.groupBy("district_id").agg(
        F.countDistinct("suburb_id").alias("suburb_count"),
        F.countDistinct(F.when(F.col("is_major_suburb"), F.col("suburb_id"))).alias("major_suburb_count"))
    return (districts.select("district_id", "region_id", "code", "name")
            .join(prim, "district_id", "left").join(cnt, "district_id", "left")
            .select("district_id", "region_id", "code", F.col("name").alias("official_name"),
                    F.coalesce("_alias", "name").alias("display_name"),
                    F.coalesce("suburb_count", F.lit(0)).cast("long").alias("suburb_count"),
                    F.coalesce("major_suburb_count", F.lit(0)).cast("long").alias("major_suburb_count")))


def suburbs_view(suburbs: DataFrame, streets: DataFrame) -> DataFrame:
    """v_suburbs with the real street count and the sort priority."""
    cnt = streets.groupBy("suburb_id").agg(F.countDistinct("street_name").alias("street_count"))
    return (suburbs.select("suburb_id", "district_id", "name", "major_name", "is_major_suburb",
                           "population_category")
            .join(cnt, "suburb_id", "left")
            .select("suburb_id", "district_id", "name", "major_name", "is_major_suburb", "population_category",
                    F.coalesce("street_count", F.lit(0)).cast("long").alias("street_count"),
                    F.when(F.col("is_major_suburb"), 0).otherwise(1).alias("sort_priority")))


def children(view: DataFrame, parent_col: str, parents: DataFrame) -> DataFrame:
    """B5 batch form: rows of ``view`` whose parent id is in ``parents``."""
    return view.join(parents.select(F.col(parent_col)).distinct(), parent_col, "left_semi")


def normalized_key(c):
    return text.norm_key(c)


# ---------------------------------------------------------------------------
# API-shaped browse calls (ordered), batch form: one row per child of every
# requested parent
# ---------------------------------------------------------------------------

def browse_regions(view: DataFrame) -> DataFrame:
    """regions() ordered by name."""
    return view.select("region_id", "name", "district_count").orderBy("name", "region_id")


def browse_districts(view: DataFrame, region_ids: DataFrame) -> DataFrame:
    """districts(region_id) ordered by display name."""
    return (children(view, "region_id", region_ids)
            .select("district_id", "region_id", F.col("display_name").alias("name"), "suburb_count")
            .orderBy("region_id", "name", "district_id"))


def browse_suburbs(view: DataFrame, district_ids: DataFrame) -> DataFrame:
    """suburbs(district_id) ordered by sort priority then name; name_ascii is
    always null and major_name repeats the name, as the service returns."""
    return (children(view, "district_id", district_ids)
            .select("suburb_id", "district_id", "name", F.lit(None).cast("string").alias("name_ascii"),
                    F.col("name").alias("major_name"), "street_count", "is_major_suburb", "population_category",
                    "sort_priority")
            .orderBy("district_id", "sort_priority", "name", "suburb_id"))


def browse_streets(streets: DataFrame, suburb_ids: DataFrame) -> DataFrame:
    """streets(suburb_id) ordered by street name."""
    return children(streets, "suburb_id", suburb_ids).orderBy("suburb_id", "street_name")
