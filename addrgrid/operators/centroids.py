"""Suburb centroid fill.

The reference walks suburbs one by one and calls a remote place search for
each; here the whole table goes through one cascade of joins:

1. an address point whose locality equals the suburb name (lower/trim), the
   smallest address id per name (pre-aggregated per name, so a large
   locality never gathers in one task);
2. the same with the abbreviation-expanded name;
3. a gazetteer table (query_text, lat, lon) standing in for the remote
   search, probed with the ordered list of query variants; the lowest-ranked
   hit wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .abbreviations import with_expanded

# Legacy districts searched under the metropolitan name, and
# that name.
LEGACY_DISTRICTS = ("Manukau City", "North Shore City", "Waitakere City", "Rodney", "Franklin")
METRO_NAME = "Auckland"
CITY_CENTRE = "City Centre"
# Abbreviations named by the reference (the full table is caller data).
DEFAULT_ABBREVIATIONS = [("St", "Saint", "prefix"), ("Mt", "Mount", "prefix")]


def query_variants(s: DataFrame) -> DataFrame:
    """Explode (suburb_id, rank, query_text) in the reference's order.

    ``s`` has suburb_id, name, expanded, district_name, region_name.
    """
    name, exp, dist, reg = F.col("name"), F.col("expanded"), F.col("district_name"), F.col("region_name")
    nz = F.lit("New Zealand")

    def q(*parts):
        return F.concat_ws(", ", *parts, nz)

    no_city = text.strip_suffix(dist, "City")
    no_island = text.strip_suffix(dist, "Island")
    cc = name == F.lit(CITY_CENTRE)
    v = [
        (1, F.when(cc, q(dist)).otherwise(q(name, dist))),
        (2, F.when(~cc & (exp != name), q(exp, dist))),
        (3, F.when(dist.endswith(" City"), q(exp, no_city))),
        (4, F.when(dist.endswith(" Island"), q(exp, no_island))),
        (5, F.when(dist.isin(*LEGACY_DISTRICTS), q(exp, F.lit(METRO_NAME)))),
        (6, F.when(reg.isNotNull() & (reg != dist), q(exp, reg))),
    ]
    arr = F.array(*[F.struct(F.lit(r).alias("rank"), c.alias("query_text")) for r, c in v])
    return (s.select("suburb_id", F.explode(arr).alias("v"))
            .select("suburb_id", "v.rank", "v.query_text", text.place_query_url("v.query_text").alias("query_url"))
            .where(F.col("query_text").isNotNull()))


def fill_centroids(suburbs: DataFrame, districts: DataFrame, regions: DataFrame, addresses: DataFrame,
                   abbreviations: DataFrame, gazetteer: DataFrame, polygon: bool = False) -> DataFrame:
    """Per suburb without a centroid: (suburb_id, source, query_text,
    centroid_x, centroid_y) in NZTM; source is null when nothing was found.
    With ``polygon``, the centre of the suburb's own area (I16) is the last
    resort (source ``polygon``)."""
    todo = suburbs.where(F.col("centroid").isNull()) if "centroid" in suburbs.columns else suburbs
    s = (todo.select("suburb_id", "name", "district_id")
         .join(districts.select("district_id", F.col("name").alias("district_name"), "region_id"), "district_id")
         .join(regions.select("region_id", F.col("name").alias("region_name")), "region_id", "left"))
    s = with_expanded(s, "name", abbreviations)
    by_name = (addresses.where(F.col("gx").isNotNull() & F.col("gy").isNotNull())
               .groupBy(text.norm_key("suburb_locality").alias("k"))
               .agg(F.min_by("gx", "address_id").alias("ax"), F.min_by("gy", "address_id").alias("ay")))
    c1 = by_name.select(F.col("k").alias("k1"), F.col("ax").alias("x1"), F.col("ay").alias("y1"))
    c2 = by_name.select(F.col("k").alias("k2"), F.col("ax").alias("x2"), F.col("ay").alias("y2"))
    s = (s.join(c1, F.lower(F.col("name")) == F.col("k1"), "left")
         .join(c2, (F.col("expanded") != F.col("name")) & (F.lower(F.col("expanded")) == F.col("k2")), "left"))
    # gazetteer: one point per query text (rule D: smallest lat, lon)
    gz = gazetteer.groupBy("query_text").agg(F.min(F.struct("lat", "lon")).alias("p"))
    hits = (query_variants(s.where(F.col("x1").isNull() & F.col("x2").isNull())).drop("query_url")
            .join(gz, "query_text")
            .groupBy("suburb_id").agg(F.min(F.struct("rank", "query_text", "p")).alias("h")))
    hits = hits.select("suburb_id", F.col("h.query_text").alias("g_query"), F.col("h.p.lat").alias("g_lat"),
                       F.col("h.p.lon").alias("g_lon"))
    hits = geo.with_nztm(hits, "g_lon", "g_lat", "x3", "y3")
    out = s.join(hits, "suburb_id", "left")
    own = todo.select("suburb_id", geo.centroid("geom").alias("p")) if polygon else None
    out = (out.join(own.select("suburb_id", F.col("p.x").alias("x4"), F.col("p.y").alias("y4")), "suburb_id", "left")
           if polygon else out.withColumn("x4", F.lit(None).cast("double")).withColumn("y4", F.lit(None).cast("double")))
    source = (F.when(F.col("x1").isNotNull(), "address").when(F.col("x2").isNotNull(), "address_expanded")
              .when(F.col("x3").isNotNull(), "gazetteer").when(F.col("x4").isNotNull(), "polygon"))
    return out.select("suburb_id", source.alias("source"), F.col("g_query").alias("query_text"),
                      F.coalesce("x1", "x2", "x3", "x4").alias("centroid_x"), F.coalesce("y1", "y2", "y3", "y4").alias("centroid_y"))
