"""Nested locality documents -> regions, districts, suburbs.

Input: one row per document with ``doc: array<region>`` (see
``sources.readers.read_locality_json``). A document is exploded with its
ordinal, so region ids keep counting the skipped aggregate element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The aggregate element that is not a region.
AGGREGATE_NAME = "All"


def regions_from_documents(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """region_id = R{ordinal:02d} (1-based position in the document, the
    aggregate element counted but skipped), name."""
    r = docs.select(F.posexplode_outer(doc_col).alias("pos", "region"))
    r = r.where(F.col("region").isNotNull() & (F.col("region.Name") != AGGREGATE_NAME))
    return r.select(text.format_id("R", 2, F.col("pos") + 1).alias("region_id"), F.col("region.Name").alias("name"))


def hierarchy_from_documents(docs: DataFrame, region_map: DataFrame, doc_col: str = "doc"):
    """Districts and suburbs, region ids taken from a name -> id mapping table.

    Returns (districts, suburbs, unknown_regions). Missing ``Districts`` or
    ``Suburbs`` arrays are tolerated (outer explodes). Regions absent from
    the mapping are reported, not loaded.
    """
    r = docs.select(F.explode_outer(doc_col).alias("region")).where(
        F.col("region").isNotNull() & (F.col("region.Name") != AGGREGATE_NAME))
    r = r.select(F.col("region.Name").alias("region_name"), F.col("region.Districts").alias("districts"))
    m = region_map.select(F.col("name").alias("region_name"), "region_id")
    known = r.join(m, "region_name", "inner")  # the map is a small dimension
    unknown = r.join(m, "region_name", "left_anti").select("region_name").distinct()
    d = known.select("region_id", F.explode_outer("districts").alias("d")).where(F.col("d").isNotNull())
    d = d.select("region_id", text.format_id("D", 4, F.col("d.DistrictId")).alias("district_id"),
                 F.col("d.Name").alias("name"), F.col("d.Suburbs").alias("suburbs"))
    districts = d.select("district_id", "region_id", "name", F.col("name").alias("display_name"))
    s = d.select("district_id", F.explode_outer("suburbs").alias("s")).where(F.col("s").isNotNull())
    suburbs = s.select(text.format_id("S", 5, F.col("s.SuburbId")).alias("suburb_id"), "district_id",
                       F.col("s.Name").alias("name"), F.lit(True).alias("is_major_suburb"),
                       F.lit("high").alias("population_category"))
    return districts, suburbs, unknown


def hierarchy_report(docs: DataFrame, region_map: DataFrame, doc_col: str = "doc") -> DataFrame:
    """One row per region name of the documents, known or not, in one pass
    over them: region_name, region_id (null: absent from the mapping, nothing
    of it is loaded), the documents' districts and suburbs below it."""
    r = docs.select(F.explode_outer(doc_col).alias("region")).where(
        F.col("region").isNotNull() & (F.col("region.Name") != AGGREGATE_NAME))
    districts = F.coalesce("region.Districts", F.array().cast(r.schema["region"].dataType["Districts"].dataType))
    counted = r.select(F.col("region.Name").alias("region_name"), F.size(districts).alias("districts"),
                       F.aggregate(districts, F.lit(0), lambda n, d: n + F.coalesce(F.size(d["Suburbs"]), F.lit(0)) * (
                           d["Suburbs"].isNotNull().cast("int"))).alias("suburbs"))
    total = counted.groupBy("region_name").agg(F.sum("districts").alias("districts"), F.sum("suburbs").alias("suburbs"))
    m = region_map.select(F.col("name").alias("region_name"), "region_id")
    return total.join(m, "region_name", "left").select("region_name", "region_id", "districts", "suburbs",
                                                       F.col("region_id").isNotNull().alias("known"))
