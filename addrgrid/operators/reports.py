"""Reports and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .hierarchy import CATEGORY_ORDER


def _one(df: DataFrame, label_col: str, label: str, value) -> DataFrame:
    return df.agg(value.alias("_v")).select(F.lit(label).alias(label_col), F.col("_v"))


def table_counts(regions, districts, suburbs, addresses, streets) -> DataFrame:
    """D1 + G1: row count per table."""
    parts = [("regions", regions), ("districts", districts), ("suburbs", suburbs),
             ("addresses", addresses), ("streets_by_suburb", streets)]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def top_suburbs_by_streets(suburbs, districts, streets, k: int = 10) -> DataFrame:
    """D2 + F4: suburbs with most distinct streets (ties: suburb_id)."""
    cnt = streets.groupBy("suburb_id").agg(F.countDistinct("street_name").alias("street_count"))
    d = districts.select("district_id", F.col("name").alias("district_name"))
    s = (suburbs.select("suburb_id", F.col("name").alias("suburb_name"), "district_id")
         .join(d, "district_id", "left").join(cnt, "suburb_id", "left")
         .select("suburb_id", "suburb_name", "district_name",
                 F.coalesce("street_count", F.lit(0)).cast("long").alias("street_count")))
    return s.orderBy(F.desc("street_count"), "suburb_id").limit(k)


def population_breakdown(suburbs: DataFrame) -> DataFrame:
    """D5 + E1: count and share per category, share rounded to 1 dp."""
    g = suburbs.groupBy("population_category").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy()), 1)
    order = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]),
                                        F.col("population_category")).cast("int"), F.lit(len(CATEGORY_ORDER) + 1))
    return g.select("population_category", "count", share.alias("percentage"), order.alias("sort_order"))


def integrity_report(regions, districts, suburbs) -> DataFrame:
    """C17: orphans, null keys and duplicate keys as metric/value rows."""
    orphan_d = districts.join(regions.select("region_id"), "region_id", "left_anti")
    orphan_s = suburbs.join(districts.select("district_id"), "district_id", "left_anti")
    rows = [
        _one(orphan_d, "metric", "districts_without_region", F.count(F.lit(1))),
        _one(orphan_s, "metric", "suburbs_without_district", F.count(F.lit(1))),
        _one(districts, "metric", "districts_null_region", F.count_if(F.col("region_id").isNull())),
        _one(suburbs, "metric", "suburbs_null_district", F.count_if(F.col("district_id").isNull())),
        _one(regions, "metric", "regions_duplicate_id", F.count(F.lit(1)) - F.countDistinct("region_id")),
        _one(districts, "metric", "districts_duplicate_id", F.count(F.lit(1)) - F.countDistinct("district_id")),
        _one(suburbs, "metric", "suburbs_duplicate_id", F.count(F.lit(1)) - F.countDistinct("suburb_id")),
        _one(regions, "metric", "regions_null_geometry", F.count_if(F.col("geom").isNull())),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("metric", F.col("_v").cast("long").alias("value"))


def entity_report(regions, districts, aliases, suburbs) -> DataFrame:
    """D10 + D6: entity counts, region sample = ordered names starting with
    a capital letter, joined with ', '."""
    sample = F.array_join(F.array_sort(F.collect_list(F.when(F.col("name").rlike("^[A-Z]"), F.col("name")))), ", ")
    r = regions.agg(F.count(F.lit(1)).alias("count"), sample.alias("sample_names")).select(
        F.lit("Regions").alias("entity"), "count", "sample_names")
    none = F.lit(None).cast("string")
    d = districts.agg(F.count(F.lit(1)).alias("count")).select(F.lit("Districts").alias("entity"), "count",
                                                               none.alias("sample_names"))
    a = aliases.agg(F.count(F.lit(1)).alias("count")).select(F.lit("District Aliases").alias("entity"), "count",
                                                             none.alias("sample_names"))
    s = suburbs.agg(F.count(F.lit(1)).alias("count")).select(F.lit("Suburbs").alias("entity"), "count",
                                                             none.alias("sample_names"))
    return r.unionByName(d).unionByName(a).unionByName(s)


def compare_localities(listings: DataFrame, suburbs: DataFrame) -> DataFrame:
    """Five metrics, counts as text.

    Listing names are cleaned (hyphen to space, initcap); both sides join on
    lower(trim(name)); the 'both' count counts joined pairs.
    """
    l = listings.select(text.initcap_key("suburb").alias("suburb"))
    lk = l.select(text.norm_key("suburb").alias("k"))
    sk = suburbs.select(text.norm_key("name").alias("k"))
    both = lk.join(sk, "k")
    only_l = lk.join(sk, "k", "left_anti")
    only_s = sk.join(lk, "k", "left_anti")
    parts = [("Total listing suburbs", lk), ("Total reference suburbs", sk), ("Suburbs in both", both),
             ("Only in listings", only_l), ("Only in reference", only_s)]
    out = None
    for i, (label, df) in enumerate(parts):
        one = df.agg(F.count(F.lit(1)).cast("string").alias("count")).select(
            F.lit(i + 1).alias("ord"), F.lit(label).alias("metric"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def centroid_coverage(suburbs: DataFrame) -> DataFrame:
    """Suburbs with and without a centroid, share to 1 dp."""
    return suburbs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("centroid").isNotNull()).alias("with_centroid"),
        F.count_if(F.col("centroid").isNull()).alias("without_centroid")).select(
        "*", F.round(F.lit(100.0) * F.col("with_centroid") / F.col("total"), 1).alias("percentage"))


def coverage_summary(feed: DataFrame, addresses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Feed rows, loaded, geocoded, linked to a suburb, shares (2 dp)."""
    none = F.lit(None).cast("long")
    cols = ["feed_rows", "loaded", "geocoded", "linked_suburb", "linked_district"]

    def row(df, **aggs):
        got = df.agg(*[v.alias(k) for k, v in aggs.items()])
        return got.select(*[F.col(c) if c in aggs else none.alias(c) for c in cols])

    u = (row(feed, feed_rows=F.count(F.lit(1)))
         .unionByName(row(addresses, loaded=F.count(F.lit(1)),
                          geocoded=F.count_if(F.col("gx").isNotNull() & F.col("gy").isNotNull())))
         .unionByName(row(resolved, linked_suburb=F.count_if(F.col("suburb_id").isNotNull()),
                          linked_district=F.count_if(F.col("district_id").isNotNull()))))
    j = u.agg(*[F.max(c).alias(c) for c in cols])  # three one-row aggregates folded into one row
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("loaded"), 2)
    return j.select(*cols, pct("geocoded").alias("geocoded_pct"), pct("linked_suburb").alias("linked_suburb_pct"))


def job_summary(results: DataFrame, ok_col: str = "success") -> DataFrame:
    """Processed, ok, failed, success % to 1 dp."""
    return results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(ok_col)).alias("ok"),
                       F.count_if(~F.col(ok_col)).alias("failed")).select(
        "*", F.round(F.lit(100.0) * F.col("ok") / F.col("processed"), 1).alias("success_pct"))


def addresses_per_suburb(resolved: DataFrame, suburbs: DataFrame, k: int = 10) -> DataFrame:
    """Suburbs with most address points (ties: suburb_id), top k.
    Counting happens before the join (map-side partial aggregation)."""
    cnt = resolved.where(F.col("suburb_id").isNotNull()).groupBy("suburb_id").agg(
        F.count(F.lit(1)).alias("address_count"))
    return (cnt.join(suburbs.select("suburb_id", F.col("name").alias("suburb_name")), "suburb_id")
            .orderBy(F.desc("address_count"), "suburb_id").limit(k))


def locality_samples(listings: DataFrame, suburbs: DataFrame, k: int = 30) -> DataFrame:
    """The first ``k`` names by the alphabet that only the
    listings have, that only the reference has, and that both have: (section,
    ord, name). Names are compared as in ``compare_localities``; the samples
    are the report's own, and each is a top-k by partial sorts."""
    lk = listings.select(text.norm_key(text.initcap_key("suburb")).alias("k")).where("k is not null").distinct()
    sk = suburbs.select(text.norm_key("name").alias("k")).where("k is not null").distinct()
    sides = (lk.select("k", F.lit(1).alias("l"), F.lit(0).alias("s")).union(sk.select("k", F.lit(0), F.lit(1)))
             .groupBy("k").agg(F.max("l").alias("l"), F.max("s").alias("s")))
    section = (F.when((F.col("l") == 1) & (F.col("s") == 1), "in both").when(F.col("l") == 1, "only in listings")
               .otherwise("only in reference"))
    ranked = sides.select(section.alias("section"), F.col("k").alias("name")).withColumn(
        "ord", F.row_number().over(Window.partitionBy("section").orderBy("name")))
    return ranked.where(F.col("ord") <= k).select("section", "ord", "name")
