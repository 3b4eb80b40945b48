"""Address verification for a table of free-text requests.

One output row per request. The reference tries strategies one request at a
time; here every strategy runs once for the whole table:

1. normalise + tokenise (column expressions);
2. exact and smart patterns are collected, de-duplicated and matched in one
   join (``matching.match_patterns``);
3. only requests that neither strategy resolved go to the trigram join;
4. the strategy order per request (3+ tokens: smart, exact, fuzzy; else
   exact, smart, fuzzy) is a ``coalesce`` over the candidate columns;
5. the hierarchy of the distinct chosen addresses is resolved spatially.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from . import hierarchy, matching

# Result messages.
MSG_EMPTY = "Address cannot be empty"
MSG_NOT_FOUND = "Address not found in LINZ data"
MSG_EXACT = "Match found"
MSG_EXACT_NO_GEOM = "Address found but missing spatial data"
MSG_UNIQUE = "Unique match found"
MSG_SUCCESS = "Coordinates found successfully"


def _pattern(number, street, city):
    return F.struct(number.alias("number"), street.alias("street"), city.alias("city"))


def verify(raw: DataFrame, addresses: DataFrame, suburbs: DataFrame, districts: DataFrame,
           key: str = "raw_id", col: str = "raw_address") -> DataFrame:
    """Verify every request; columns: key, exists_in_source, address_id,
    full_address, x, y, region_id, district_id, suburb_id, message, strategy."""
    r = raw.select(key, text.is_blank(col).alias("blank"), text.normalize(col).alias("norm"))
    r = r.withColumn("toks", F.filter(F.split("norm", " "), lambda t: t != ""))
    r = r.withColumn("ntok", F.size("toks"))
    r = cut_lineage(text.with_smart_parse(text.with_exact_parse(r, "toks"), "toks").drop("toks"))
    live = r.where(~F.col("blank"))
    null_s = F.lit(None).cast("string")
    pats = (live.select(F.explode(F.array(
        _pattern(F.col("ex_number"), F.col("ex_road"), null_s),
        _pattern(F.col("sm_number"), F.col("sm_street1"), F.col("sm_city1")),
        _pattern(F.col("sm_number"), F.col("sm_street2"), F.col("sm_city2")))).alias("p"))
        .select("p.*").where(F.col("number").isNotNull() & F.col("street").isNotNull()))
    m = matching.match_patterns(pats, addresses)

    def attach(df, prefix, number, street, city):
        mm = m.select(*[F.col(c).alias(f"{prefix}_{c}") for c in m.columns])
        cond = ((F.col(f"{prefix}_number") == number) & (F.col(f"{prefix}_street") == street)
                & F.col(f"{prefix}_city").eqNullSafe(city))
        return df.join(mm, cond, "left").drop(f"{prefix}_number", f"{prefix}_street", f"{prefix}_city")

    x = attach(live, "e", F.col("ex_number"), F.col("ex_road"), null_s)
    x = attach(x, "s1", F.col("sm_number"), F.col("sm_street1"), F.col("sm_city1"))
    x = attach(x, "s2", F.col("sm_number"), F.col("sm_street2"), F.col("sm_city2"))

    def pick(id_col, n_col, kind, msg):
        return F.when(F.col(id_col).isNotNull(), F.struct(
            F.col(id_col).alias("address_id"), F.lit(kind).alias("strategy"), msg.alias("msg"),
            F.lit(None).cast("float").alias("sim")))

    smart_msg = lambda n: F.when(F.col(n) == 1, F.lit(MSG_UNIQUE)).otherwise(
        F.concat(F.lit("Match found ("), F.col(n).cast("string"), F.lit(" matches)")))
    smart = F.coalesce(pick("s1_best_id", "s1_n_match", "smart", smart_msg("s1_n_match")),
                       pick("s2_best_id", "s2_n_match", "smart", smart_msg("s2_n_match")))
    exact = pick("e_best_id", "e_n_match", "exact", F.lit(MSG_EXACT))
    x = x.select(key, "norm", F.when(F.col("ntok") >= 3, F.coalesce(smart, exact))
                 .otherwise(F.coalesce(exact, smart)).alias("hit"))

    x = cut_lineage(x)
    # identical normalised texts are searched once
    residue = x.where(F.col("hit").isNull()).select("norm").distinct()
    fz = matching.similarity_join(residue, addresses, req_key="norm", req_text="norm")
    x = x.join(fz.select("norm", F.col("address_id").alias("f_id"), F.col("sim").alias("f_sim")), "norm", "left")
    fuzzy = F.when(F.col("f_id").isNotNull(), F.struct(
        F.col("f_id").alias("address_id"), F.lit("fuzzy").alias("strategy"), F.lit(None).cast("string").alias("msg"),
        F.col("f_sim").alias("sim")))
    x = cut_lineage(x.select(key, F.coalesce("hit", fuzzy).alias("hit")))

    a = addresses.select("address_id", "full_address", "x_coord", "y_coord", "gx", "gy")
    chosen = x.select(key, F.col("hit.address_id").alias("address_id"), F.col("hit.strategy").alias("strategy"),
                      F.col("hit.msg").alias("msg"), F.col("hit.sim").alias("sim"))
    # requests without an address stay out of the joins: they would all share the null key
    nowhere = chosen.where(F.col("address_id").isNull())
    chosen = cut_lineage(chosen.where(F.col("address_id").isNotNull()).join(a, "address_id", "left"))
    ids = chosen.select("address_id", "gx", "gy").distinct()
    h = hierarchy.resolve_hierarchy(ids, suburbs, districts, key="address_id", x="gx", y="gy")
    chosen = chosen.join(h, "address_id", "left").unionByName(nowhere, allowMissingColumns=True)

    has_geom = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    sim2 = F.format_string("%.2f", F.col("sim").cast("double"))
    msg = (F.when(F.col("address_id").isNull(), F.lit(MSG_NOT_FOUND))
           .when((F.col("strategy") == "exact") & ~has_geom, F.lit(MSG_EXACT_NO_GEOM))
           .when((F.col("strategy") == "fuzzy") & ~has_geom,
                 F.concat(F.lit("Address found (similarity: "), sim2, F.lit(") but missing spatial data")))
           .when(F.col("strategy") == "fuzzy", F.concat(F.lit("Fuzzy match found (similarity: "), sim2, F.lit(")")))
           .otherwise(F.col("msg")))
    hier = lambda c: F.when(has_geom, F.col(c))
    found = chosen.select(
        key, F.col("address_id").isNotNull().alias("exists_in_source"), "address_id", "full_address",
        F.col("x_coord").alias("x"), F.col("y_coord").alias("y"), hier("region_id").alias("region_id"),
        hier("district_id").alias("district_id"), hier("suburb_id").alias("suburb_id"), msg.alias("message"),
        F.coalesce("strategy", F.lit("none")).alias("strategy"))
    blank = r.where(F.col("blank")).select(
        key, F.lit(False).alias("exists_in_source"), F.lit(None).cast("long").alias("address_id"),
        F.lit(None).cast("string").alias("full_address"), F.lit(None).cast("double").alias("x"),
        F.lit(None).cast("double").alias("y"), *[F.lit(None).cast("string").alias(c)
                                                 for c in ("region_id", "district_id", "suburb_id")],
        F.lit(MSG_EMPTY).alias("message"), F.lit("blank").alias("strategy"))
    return found.unionByName(blank)


def coordinates_for_address(raw: DataFrame, addresses: DataFrame, suburbs: DataFrame, districts: DataFrame,
                            key: str = "raw_id", col: str = "raw_address") -> DataFrame:
    """Success flag, latitude = y, longitude = x, verification details."""
    v = verify(raw, addresses, suburbs, districts, key=key, col=col)
    ok = F.col("exists_in_source") & F.col("x").isNotNull() & F.col("y").isNotNull()
    details = F.struct(*[F.col(c) for c in v.columns if c != key])
    return v.select(key, ok.alias("success"), F.when(ok, F.col("y")).alias("latitude"),
                    F.when(ok, F.col("x")).alias("longitude"), details.alias("address_details"),
                    F.when(ok, F.lit(MSG_SUCCESS)).otherwise(F.col("message")).alias("message"))
