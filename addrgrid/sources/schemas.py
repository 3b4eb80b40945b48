"""Declared schemas of the inputs (A1, A3, A4, A8) and the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

# A1: address feed, columns in file order.
ADDRESS_FEED = T.StructType([
    T.StructField("fid", S), T.StructField("address_id", L), T.StructField("source_dataset", S),
    T.StructField("change_id", L), T.StructField("full_address_number", S),
    T.StructField("full_road_name", S), T.StructField("full_address", S),
    T.StructField("territorial_authority", S), T.StructField("unit_type", S),
    T.StructField("unit_value", S), T.StructField("level_type", S), T.StructField("level_value", S),
    T.StructField("address_number_prefix", S), T.StructField("address_number", I),
    T.StructField("address_number_suffix", S), T.StructField("address_number_high", S),
    T.StructField("road_name_prefix", S), T.StructField("road_name", S),
    T.StructField("road_type_name", S), T.StructField("road_suffix", S),
    T.StructField("water_name", S), T.StructField("water_body_name", S),
    T.StructField("suburb_locality", S), T.StructField("town_city", S),
    T.StructField("address_class", S), T.StructField("address_lifecycle", S),
    T.StructField("gd2000_xcoord", D), T.StructField("gd2000_ycoord", D),
    T.StructField("road_name_ascii", S), T.StructField("water_name_ascii", S),
    T.StructField("water_body_name_ascii", S), T.StructField("suburb_locality_ascii", S),
    T.StructField("town_city_ascii", S), T.StructField("full_road_name_ascii", S),
    T.StructField("full_address_ascii", S), T.StructField("shape", S),
])

# A3: boundary staging feeds (WKT geometry column last).
REGION_STAGE = T.StructType([
    T.StructField("fid", S), T.StructField("id", S), T.StructField("name", S),
    T.StructField("name_ascii", S), T.StructField("land_area_sq_km", D), T.StructField("area_sq_km", D),
    T.StructField("shape_length", D), T.StructField("shape_area", D), T.StructField("shape", S)])
DISTRICT_STAGE = REGION_STAGE
SUBURB_STAGE = T.StructType([
    T.StructField("fid", S), T.StructField("id", I), T.StructField("name", S),
    T.StructField("additional_name", S), T.StructField("type", S), T.StructField("major_name", S),
    T.StructField("major_name_type", S), T.StructField("territorial_authority", S),
    T.StructField("population_estimate", I), T.StructField("name_ascii", S),
    T.StructField("additional_name_ascii", S), T.StructField("major_name_ascii", S),
    T.StructField("territorial_authority_ascii", S), T.StructField("shape", S)])

# A4: nested locality JSON.
SUBURB_NODE = T.StructType([T.StructField("SuburbId", I), T.StructField("Name", S)])
DISTRICT_NODE = T.StructType([T.StructField("DistrictId", I), T.StructField("Name", S),
                              T.StructField("Suburbs", T.ArrayType(SUBURB_NODE))])
REGION_NODE = T.StructType([T.StructField("Name", S), T.StructField("Districts", T.ArrayType(DISTRICT_NODE))])
LOCALITY_JSON = T.ArrayType(REGION_NODE)

# Listing CSV; abbreviations; gazetteer (stands in for the remote lookup).
LISTINGS = T.StructType([T.StructField("region", S), T.StructField("district", S), T.StructField("suburb", S)])
ABBREVIATIONS = T.StructType([T.StructField("short_form", S), T.StructField("long_form", S),
                              T.StructField("category", S)])
GAZETTEER = T.StructType([T.StructField("query_text", S), T.StructField("lat", D), T.StructField("lon", D)])

# Stored addresses table (15 columns + the NZTM point as gx/gy).
ADDRESS_COLUMNS = [
    "address_id", "full_address", "full_address_ascii", "full_road_name", "full_road_name_ascii",
    "address_number_prefix", "address_number", "address_number_suffix", "suburb_locality",
    "suburb_locality_ascii", "town_city", "territorial_authority", "x_coord", "y_coord", "gx", "gy"]

# VARCHAR(n) widths of the stored tables (B2).
VARCHAR_WIDTH = {
    "full_road_name": 200, "full_road_name_ascii": 200, "address_number_prefix": 10,
    "address_number_suffix": 10, "suburb_locality": 200, "suburb_locality_ascii": 200,
    "town_city": 200, "territorial_authority": 200}
