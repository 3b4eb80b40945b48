"""Candidate matching joins for address verification.

Number + street substring (C14/C15)
    Requests are reduced to distinct patterns (number, street, city) before
    the join, so a thousand identical requests cost one probe. The join key is
    (house number, rarest literal 3-gram of the street) against a road-gram
    index, with the substring test as residual; the per-pattern winner is a
    partial (map-side) aggregate, so a hot house number never gathers its
    matches into one group.

Trigram similarity (C16)
    Prefix-filtered set-similarity join: grams are ordered globally by
    (document frequency, gram); a pair with Jaccard >= t must share one of
    the first ``n - ceil(t*n) + 1`` grams of each side, so only those are
    joined. The gram dictionary is bounded by the alphabet (not by the
    data). Candidates are verified exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, trigram
from ..session import cut_lineage


def _windows(s, n: int):
    """All length-n substrings of s (empty when s is shorter than n; note that
    ``sequence(1, 0)`` would count down)."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1),
                                                lambda i: F.substring(s, i, n))).otherwise(
        F.array().cast("array<string>"))


def road_grams(addresses: DataFrame) -> DataFrame:
    """(address_number, gram, address_id): distinct lower-case 3-grams of the
    road name and its ASCII form -- the inverted index of the substring join
    (reusable across request batches)."""
    a = addresses.where(F.col("address_number").isNotNull())
    g = F.array_distinct(F.concat(F.coalesce(_windows(F.lower("full_road_name"), 3), F.array()),
                                  F.coalesce(_windows(F.lower("full_road_name_ascii"), 3), F.array())))
    return a.select("address_number", "address_id", F.explode(g).alias("gram"))


def match_patterns(patterns: DataFrame, addresses: DataFrame) -> DataFrame:
    """For distinct patterns (number, street, city) return
    (number, street, city, n_match, best_id, best_prio).

    n_match is capped at 5 (the reference reads at most 5 rows). The best row
    orders by city priority (1 = city text in suburb or town, 2 otherwise;
    0 without a city), then street quality (1 exact case-sensitive road name,
    2 prefix, 3 other; 0 without a city), then address_id.

    Candidate generation never pairs a pattern with every address of its
    house number:
    * street with a literal 3-gram: equi-join on (number, rarest gram) with
      the road-gram index, then the exact ILIKE test;
    * empty street (number only, matches any named road): one per-number
      aggregate, no pairs at all;
    * 1-2 literal characters: (number, 2- or 1-gram) against an index of
      only the house numbers those patterns use;
    * wildcards only: number join + ILIKE (rare).
    """
    p = patterns.select("number", "street", "city").distinct()
    # a pattern sees only these columns: addresses equal in them are matched once, by number and smallest id
    seen = ["address_number", "full_road_name", "full_road_name_ascii", "suburb_locality", "town_city"]
    a = cut_lineage(addresses.groupBy(*seen).agg(F.count(F.lit(1)).alias("_rows"), F.min("address_id").alias("best_id"))
                    .withColumn("address_id", F.monotonically_increasing_id()))
    low = F.lower(F.col("street"))
    lit3 = F.filter(_windows(low, 3), lambda g: ~g.rlike(r"[%_\\]"))
    p = p.withColumn("_g", lit3)
    idx = road_grams(a)
    freq = idx.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))  # bounded by the alphabet
    keyed = (p.where(F.size("_g") > 0).select("number", "street", "city", F.explode("_g").alias("gram"))
             .join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
             .groupBy("number", "street", "city").agg(F.min(F.struct("df", "gram")).alias("_k"))
             .select("number", "street", "city", F.col("_k.gram").alias("gram")))
    cand = keyed.join(idx.withColumnRenamed("gram", "_ig"),
                      (F.col("number") == F.col("address_number")) & (F.col("gram") == F.col("_ig")))
    cand = cand.select("number", "street", "city", "address_id").join(a, "address_id")
    # 1-2 literal characters: key on (number, 2-gram or 1-gram) against an
    # index built only for the house numbers these patterns use
    short = p.where((F.size("_g") == 0) & (F.col("street") != "")).drop("_g")
    lit2 = F.filter(_windows(low, 2), lambda g: ~g.rlike(r"[%_\\]"))
    lit1 = F.filter(_windows(low, 1), lambda g: ~g.rlike(r"[%_\\]"))
    short = short.withColumn("_n", F.when(F.size(lit2) > 0, 2).when(F.size(lit1) > 0, 1)).withColumn(
        "_sg", F.coalesce(F.try_element_at(lit2, F.lit(1)), F.try_element_at(lit1, F.lit(1))))
    nums = short.where(F.col("_sg").isNotNull()).select(F.col("number").alias("address_number")).distinct()
    sub = a.join(nums, "address_number", "left_semi")
    small_idx = None
    for n in (1, 2):
        g = F.array_distinct(F.concat(F.coalesce(_windows(F.lower("full_road_name"), n), F.array()),
                                      F.coalesce(_windows(F.lower("full_road_name_ascii"), n), F.array())))
        part = sub.select("address_number", "address_id", F.lit(n).alias("_in"), F.explode(g).alias("_ig"))
        small_idx = part if small_idx is None else small_idx.unionByName(part)
    keyed_short = short.where(F.col("_sg").isNotNull())
    cand_keyed = (keyed_short.join(small_idx, (F.col("number") == F.col("address_number"))
                                   & (F.col("_n") == F.col("_in")) & (F.col("_sg") == F.col("_ig")))
                  .select("number", "street", "city", "address_id").join(a, "address_id"))
    # no literal character at all (wildcards only): house number alone
    bare = short.where(F.col("_sg").isNull()).drop("_n", "_sg")
    cand_bare = bare.join(a, F.col("number") == F.col("address_number"))
    j = cand.unionByName(cand_keyed.select(*cand.columns)).unionByName(cand_bare.select(*cand.columns))
    j = j.where(text.contains_ci("full_road_name_ascii", "street") | text.contains_ci("full_road_name", "street"))
    has_city = F.col("city").isNotNull() & (F.col("city") != "")
    prio = F.when(~has_city, F.lit(0)).when(
        text.contains_ci("suburb_locality", "city") | text.contains_ci("town_city", "city"), F.lit(1)
    ).otherwise(F.lit(2))
    qual = F.when(~has_city, F.lit(0)).when(F.col("full_road_name") == F.col("street"), F.lit(1)).when(
        text.startswith_ci("full_road_name", "street"), F.lit(2)).otherwise(F.lit(3))
    j = j.select("number", "street", "city", F.struct(prio.alias("prio"), qual.alias("qual"),
                                                       F.col("best_id").alias("id")).alias("k"), "_rows")
    g = j.groupBy("number", "street", "city").agg(F.sum("_rows").alias("_n"), F.min("k").alias("_k"))
    matched = g.select("number", "street", "city", F.least(F.col("_n"), F.lit(5)).cast("int").alias("n_match"),
                       F.col("_k.id").alias("best_id"), F.col("_k.prio").alias("best_prio"))
    # number only: every address with a named road qualifies; city is null here
    named = a.where(F.col("full_road_name").isNotNull() | F.col("full_road_name_ascii").isNotNull())
    per_number = named.groupBy("address_number").agg(F.sum("_rows").alias("_n"), F.min("best_id").alias("best_id"))
    empty = (p.where(F.col("street") == "").drop("_g")
             .join(per_number, F.col("number") == F.col("address_number"))
             .select("number", "street", "city", F.least(F.col("_n"), F.lit(5)).cast("int").alias("n_match"),
                     "best_id", F.when(F.col("city").isNull() | (F.col("city") == ""), F.lit(0))
                     .otherwise(F.lit(2)).alias("best_prio")))
    return matched.unionByName(empty)


def prefix_len(n, t):
    """Prefix length |x| - ceil(t|x|) + 1 for Jaccard >= t (t a number or Column)."""
    tc = t if not isinstance(t, (int, float)) else F.lit(t)
    return n - F.ceil(tc * n).cast("int") + 1


#: sets that one key of the gram join holds at most, on average
POSTINGS = 20000


def salted_join(small: DataFrame, big: DataFrame, key, big_id: str, salts: int = 32) -> DataFrame:
    """Equi-join on a hot key spread over ``salts`` tasks: the small side is
    replicated per salt, the big side gets salt = hash(row id) mod salts."""
    keys = [key] if isinstance(key, str) else list(key)
    sm = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    bg = big.withColumn("_salt", F.pmod(F.xxhash64(big_id), F.lit(salts)))
    return sm.join(bg, [*keys, "_salt"]).drop("_salt")


def _ranked(df: DataFrame, key: str, grams_col: str, freq: DataFrame) -> DataFrame:
    """Grams of each set with df, their place ``ord`` in the global order
    (frequency, then a checksum, so that it fits a number; equal ones by the
    gram itself), their 1-based position in the set, and the set size."""
    e = df.select(key, F.size(grams_col).alias("_n"), F.explode(grams_col).alias("gram"))
    e = e.join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    e = e.withColumn("ord", F.shiftleft(F.col("df").cast("long"), 24) + F.shiftright(F.crc32("gram"), 8))
    w = Window.partitionBy(key).orderBy("ord", "gram")
    return e.withColumn("_pos", F.row_number().over(w))


def _prefix(ranked: DataFrame, key: str, t) -> DataFrame:
    """Prefix of each ranked set at threshold t (grams that occur at all), each
    row with ``last``, the place of the prefix's last gram."""
    p = ranked.where(F.col("_pos") <= prefix_len(F.col("_n"), t))
    return p.withColumn("last", F.max("ord").over(Window.partitionBy(key))).where("df > 0")


def similarity_join(requests: DataFrame, addresses: DataFrame, req_key: str = "rid",
                    req_text: str = "norm", threshold: float = 0.6,
                    levels: tuple[float, ...] = (0.9, 0.75)) -> DataFrame:
    """Per request the address with the highest trigram similarity of
    ``full_address_ascii`` to the request text, only if similarity > threshold
    (single-precision value widened to double). Ties -> smallest address_id.

    Exact top-1 search as a threshold cascade (``levels`` then
    ``threshold``). At level t only the requests still unresolved take part:
    prefix filter (request prefix of |x| - ceil(t|x|) + 1 grams in the global
    (frequency, gram) order; address prefix at the base threshold, computed
    once), length filter t|x| <= |y| <= |x|/t and overlap filter: of the two
    prefixes the one that ends first in the global order was compared in full,
    so the overlap is at most the shared prefix grams plus what that set has
    beyond its prefix, and must reach t/(1+t)*(|x|+|y|). A request with
    a verified pair >= t is resolved: every better pair was a candidate. High
    levels use tiny prefixes of rare grams, so hot grams are join keys only
    for the few requests whose best match is weak. Gram joins are salted by the
    frequency of the gram, equal address texts are compared once, and no level
    runs for nobody.

    Output: (req_key, address_id, sim float).
    """
    eps = 1e-6
    R = requests.select(F.col(req_key).alias("_key"), trigram.trigrams(req_text).alias("g"))
    # numbers, stored here, so that pairs are narrow
    R = cut_lineage(R.where(F.size("g") > 0).withColumn("_rid", F.monotonically_increasing_id()))
    names, R = R.select("_rid", "_key"), R.drop("_key")
    # equal texts have equal grams: one of them takes part, for its smallest id
    texts = (addresses.where(F.col("full_address_ascii").isNotNull()).groupBy(F.lower("full_address_ascii").alias("_text"))
             .agg(F.min("address_id").alias("address_id")).where(F.col("address_id").isNotNull()))
    # gram sets are read several times (index, prefixes, verification)
    A = cut_lineage(texts.select("address_id", trigram.trigrams("_text").alias("g")).where(F.size("g") > 0)
                    .withColumn("_aid", F.monotonically_increasing_id()))
    freq = (A.select(F.explode("g").alias("gram")).groupBy("gram")
            .agg(F.count(F.lit(1)).alias("df")))  # bounded by the alphabet
    rr = cut_lineage(_ranked(R, "_rid", "g", freq))
    # a gram has as many salts as it has sets, so rare grams are not copied and hot ones fill no task
    parts = F.floor(F.col("df") / F.lit(POSTINGS)) + 1
    ap = cut_lineage(_prefix(_ranked(A.drop("address_id"), "_aid", "g", freq), "_aid", threshold - eps)
                     .select("_aid", "gram", F.col("_n").alias("na"), F.col("last").alias("a_last"),
                             F.pmod(F.xxhash64("_aid"), parts).alias("_salt")))

    def verify_pairs(pairs: DataFrame) -> DataFrame:
        c = pairs.join(R.withColumnRenamed("g", "rg"), "_rid").join(A.withColumnRenamed("g", "ag"), "_aid")
        inter = F.size(F.array_intersect("rg", "ag"))
        sim = (inter / (F.size("rg") + F.size("ag") - inter)).cast("float")
        return c.select("_rid", "address_id", sim.alias("sim"))

    todo = rr
    found = None
    for lvl in [*[x for x in levels if x > threshold], threshold]:
        if found is not None and todo.isEmpty():
            break
        t = lvl - eps
        rp = _prefix(todo, "_rid", t).select("_rid", "gram", F.col("_n").alias("nr"), F.col("last").alias("r_last"),
                                             F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_salt"))
        nr, na = F.col("nr"), F.col("na")
        r_rest, a_rest = nr - prefix_len(nr, t), na - prefix_len(na, threshold - eps)
        rest = (F.when(F.col("r_last") < F.col("a_last"), r_rest).when(F.col("r_last") > F.col("a_last"), a_rest)
                .otherwise(F.greatest(r_rest, a_rest)))
        need = F.ceil(F.lit(t / (1.0 + t)) * (nr + na))  # shared prefix grams asked for: need - rest
        cand = (rp.join(ap, ["gram", "_salt"]).where((na >= F.lit(t) * nr) & (na * F.lit(t) <= nr))
                .select("_rid", "_aid", (need - rest).alias("least"))
                .groupBy("_rid", "_aid", "least").agg(F.count(F.lit(1)).alias("shared")))
        cand = cand.where("shared >= least").select("_rid", "_aid")
        hits = cut_lineage(verify_pairs(cand).where(F.col("sim").cast("double") >= F.lit(t)))
        found = hits if found is None else found.unionByName(hits)
        if lvl > threshold:
            todo = cut_lineage(todo.join(hits.select("_rid").distinct(), "_rid", "left_anti"))
    c = found.where(trigram.above_threshold("sim", threshold))
    best = c.groupBy("_rid").agg(F.max("sim").alias("sim"))
    win = c.join(best, ["_rid", "sim"]).groupBy("_rid", "sim").agg(F.min("address_id").alias("address_id"))
    return win.join(names, "_rid").select(F.col("_key").alias(req_key), "address_id", "sim")
