"""Autocomplete for a table of queries.

The reference answers ``full_address_ascii ILIKE '%q%'`` ordered by
"starts with q" then the text, limited to ``limit`` rows. In batch form:

* each query is keyed on its rarest literal n-gram (3-grams; 2- or 1-grams
  for shorter literal runs), the gram dictionary being bounded by the
  alphabet; addresses are exploded into their distinct n-grams (the
  inverted-index side, reusable across batches);
* the equi-join on the gram yields only addresses that contain that gram,
  which are then verified with the exact ILIKE;
* the top ``limit`` per query is a row_number filter, which Spark turns into
  a partial per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .matching import salted_join

DEFAULT_LIMIT = 10
MAX_LIMIT = 50


def clamp_limit(limit: int) -> int:
    """a limit outside 1..50 becomes 10."""
    return limit if 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT


def _windows(s, n: int):
    """All length-n substrings of s (empty when s is shorter than n; note that
    ``sequence(1, 0)`` would count down)."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1),
                                                lambda i: F.substring(s, i, n))).otherwise(
        F.array().cast("array<string>"))


def address_grams(addresses: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """(address_id, n, gram): distinct lower-case n-grams of full_address_ascii."""
    low = F.lower(F.col("full_address_ascii"))
    parts = []
    for n in sizes:
        parts.append(addresses.where(F.col("full_address_ascii").isNotNull()).select(
            "address_id", F.lit(n).alias("n"), F.explode(F.array_distinct(_windows(low, n))).alias("gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _query_key_grams(q: DataFrame) -> DataFrame:
    """Literal grams of each query: the longest available size (3, else 2,
    else 1), skipping windows that contain a wildcard or escape."""
    low = F.lower(F.col("q"))
    lit3 = F.filter(_windows(low, 3), lambda g: ~g.rlike(r"[%_\\]"))
    lit2 = F.filter(_windows(low, 2), lambda g: ~g.rlike(r"[%_\\]"))
    lit1 = F.filter(_windows(low, 1), lambda g: ~g.rlike(r"[%_\\]"))
    size = F.when(F.size(lit3) > 0, 3).when(F.size(lit2) > 0, 2).when(F.size(lit1) > 0, 1)
    grams = F.when(F.size(lit3) > 0, lit3).when(F.size(lit2) > 0, lit2).otherwise(lit1)
    return q.select("query_id", "q", size.alias("n"), F.explode(F.array_distinct(grams)).alias("gram"))


def autocomplete(queries: DataFrame, addresses: DataFrame, limit: int = DEFAULT_LIMIT,
                 key: str = "query_id", col: str = "query") -> DataFrame:
    """Top ``limit`` addresses per query: query_id, rank, address_id,
    full_address, street_name, suburb, city, postal_code (always null)."""
    limit = clamp_limit(limit)
    q = queries.select(F.col(key).alias("query_id"), F.col(col).alias("raw"))
    q = q.where(~text.is_blank("raw") & (F.length("raw") >= 3))
    q = q.select("query_id", F.regexp_replace("raw", r"^(?U)\s+|(?U)\s+$", "").alias("q"))
    # identical query texts are answered once and joined back to their ids
    dq = q.select("q").distinct()
    ag = address_grams(addresses)
    freq = ag.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))  # bounded by the alphabet
    qg = (_query_key_grams(dq.withColumn("query_id", F.col("q"))).drop("query_id")
          .join(freq, ["n", "gram"], "left").withColumn("df", F.coalesce("df", F.lit(0))))
    pick = qg.groupBy("q").agg(F.min(F.struct("df", "n", "gram")).alias("k"))
    pick = pick.select("q", F.col("k.n").alias("n"), F.col("k.gram").alias("gram"))
    # one gram can key a large part of the table: salt the join
    cand = salted_join(pick, ag, ["n", "gram"], "address_id").select("q", "address_id")
    a = addresses.select("address_id", "full_address", "full_address_ascii", "full_road_name",
                         "suburb_locality", "town_city")
    m = cand.join(a, "address_id").where(text.contains_ci("full_address_ascii", "q"))
    m = m.withColumn("_sw", F.when(text.startswith_ci("full_address_ascii", "q"), 0).otherwise(1))
    # queries of wildcards only match every address with at least as many
    # characters as '_' in the query (and then also "start with" it): answer
    # them from a per-length top-k table (bounded: lengths x limit rows),
    # each query exploded over the lengths it accepts -- an equi-join.
    wild = dq.where(F.col("q").rlike(r"^[%_]+$")).select(
        "q", (F.length("q") - F.length(F.replace(F.col("q"), F.lit("_"), F.lit("")))).alias("u"))
    alen = a.where(F.col("full_address_ascii").isNotNull()).withColumn("L", F.length("full_address_ascii"))
    max_len = alen.agg(F.max("L")).first()[0] or 0  # one bounded statistic
    wl = Window.partitionBy("L").orderBy("full_address_ascii", "address_id")
    per_len = alen.withColumn("_r", F.row_number().over(wl)).where(F.col("_r") <= limit).drop("_r")
    wm = (wild.select("q", F.explode(F.sequence(F.col("u"), F.greatest(F.col("u"), F.lit(max_len)))).alias("L"))
          .join(per_len, "L").drop("L").withColumn("_sw", F.lit(0)))
    m = m.unionByName(wm.select(*m.columns))
    w = Window.partitionBy("q").orderBy("_sw", "full_address_ascii", "address_id")
    top = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    top = q.join(top, "q")
    return top.select("query_id", "rank", "address_id", "full_address", F.col("full_road_name").alias("street_name"),
                      F.col("suburb_locality").alias("suburb"), F.col("town_city").alias("city"),
                      F.lit(None).cast("string").alias("postal_code"))
