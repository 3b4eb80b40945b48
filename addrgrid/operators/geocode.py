"""Reverse geocoding (J9): nearest address for a table of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage
from . import hierarchy, knn

# Messages and the distance warning threshold (metres).
MSG_NEAREST = "Nearest address found"
MSG_NONE_NEAR = "No address found near the specified coordinates"
WARN_DISTANCE_M = 100.0


def address_for_coordinates(probes: DataFrame, addresses: DataFrame, suburbs: DataFrame,
                            districts: DataFrame, key: str = "point_id", lat: str = "lat",
                            lon: str = "lon") -> DataFrame:
    """Nearest address (NZTM distance) + its hierarchy + warning text."""
    q = geo.with_nztm(probes.select(key, lon, lat), lon, lat, "qx", "qy").select(key, "qx", "qy")
    nn = knn.nearest_points(q, addresses.select("address_id", "gx", "gy"), key, "address_id",
                            qx="qx", qy="qy", px="gx", py="gy")
    a = addresses.select("address_id", "full_address", "x_coord", "y_coord", "gx", "gy")
    hit = cut_lineage(nn.join(a, "address_id", "left"))
    h = hierarchy.resolve_hierarchy(hit.select(key, "gx", "gy"), suburbs, districts, key=key, x="gx", y="gy")
    out = q.select(key).join(hit, key, "left").join(h, key, "left")
    found = F.col("address_id").isNotNull()
    warn = F.when(F.col("distance") > WARN_DISTANCE_M,
                  F.concat(F.lit(" (Warning: Nearest address is "),
                           F.format_string("%.0f", F.col("distance")), F.lit("m away)"))).otherwise(F.lit(""))
    return out.select(
        key, found.alias("exists_in_source"), "address_id", "full_address",
        F.col("x_coord").alias("x"), F.col("y_coord").alias("y"),
        "region_id", "district_id", "suburb_id", "distance",
        F.when(found, F.concat(F.lit(MSG_NEAREST), warn)).otherwise(F.lit(MSG_NONE_NEAR)).alias("message"))
