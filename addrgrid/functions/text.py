"""Text scalars (section H): all native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# H3 transliteration: macron and acute vowels, lower then upper case.
ASCII_FROM = "āēīōūĀĒĪŌŪáéíóúÁÉÍÓÚ"
ASCII_TO = "aeiouAEIOUaeiouAEIOU"
# H10 road-type words that keep a second token inside the street name.
ROAD_TYPES = ("street", "st", "road", "rd", "avenue", "ave", "drive", "dr",
              "lane", "ln", "place", "pl", "terrace", "tce", "way", "crescent",
              "cres", "grove", "court", "ct", "parade", "highway", "hwy")


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def normalize(c) -> Column:
    """H1: trim, lower, ',' and '.' to space, collapse whitespace, trim.

    Null or all-whitespace input gives ''.
    """
    s = F.translate(F.lower(_c(c)), ",.", "  ")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.coalesce(F.trim(s), F.lit(""))


def tokens(c) -> Column:
    """H2: tokens of the normalised text (empties dropped)."""
    n = normalize(c)
    return F.filter(F.split(n, " "), lambda t: t != "")


def is_blank(c) -> Column:
    """Null or only whitespace."""
    return F.coalesce(F.regexp_like(_c(c), F.lit(r"^(?U)\s*$")), F.lit(True))


def to_ascii(c) -> Column:
    """H3 / L1: the 20-character transliteration, other accents kept."""
    return F.translate(_c(c), ASCII_FROM, ASCII_TO)


def _int_or_null(t: Column) -> Column:
    d = F.when(t.rlike(r"^[+-]?0*[0-9]{1,10}$"), t.cast("long"))
    return F.when((d >= -2147483648) & (d <= 2147483647), d.cast("int"))


def parse_int(tok) -> Column:
    """H7: strict int32 parse -- optional sign and ASCII digits, else null."""
    return _int_or_null(_c(tok))


def parse_exact(toks) -> Column:
    """H8: number = first int token; road = first non-int token (or '')."""
    t = _c(toks)
    ints = F.filter(t, lambda x: _int_or_null(x).isNotNull())
    words = F.filter(t, lambda x: _int_or_null(x).isNull())
    return F.struct(
        _int_or_null(F.try_element_at(ints, F.lit(1))).alias("number"),
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("road"))


def with_exact_parse(df: DataFrame, toks: str, prefix: str = "ex_") -> DataFrame:
    """H8 as flat columns ``{prefix}number``, ``{prefix}road`` (staged so
    Catalyst does not inline the token expression into every field)."""
    p = df.withColumn("_ex", parse_exact(toks))
    return (p.withColumn(prefix + "number", F.col("_ex.number"))
            .withColumn(prefix + "road", F.col("_ex.road")).drop("_ex"))


def with_smart_parse(df: DataFrame, toks: str, prefix: str = "sm_") -> DataFrame:
    """H9: number, then street/city split by the road-type rules.

    Adds {prefix}number, {prefix}street1, {prefix}city1 and the two-word
    retry {prefix}street2, {prefix}city2 (only when 3+ words follow the
    number and the 2nd is no road type). Tokens before the first int are
    dropped; later ints are street tokens. All null when there is no number
    or nothing after it. Built in stages: each intermediate is a column.
    """
    t = F.col(toks)
    d = df.withColumn("_idx", F.array_position(F.transform(t, lambda x: _int_or_null(x).isNotNull()),
                                               F.lit(True)).cast("int"))
    d = d.withColumn("_num", F.when(F.col("_idx") > 0, _int_or_null(F.try_element_at(t, F.col("_idx")))))
    d = d.withColumn("_rest", F.when(F.col("_idx") > 0, F.slice(t, F.col("_idx") + 1,
                                                                F.greatest(F.size(t) - F.col("_idx"), F.lit(0)))))
    d = d.withColumn("_n", F.coalesce(F.size("_rest"), F.lit(0)))
    rest, n = F.col("_rest"), F.col("_n")
    d = d.withColumn("_typ", F.coalesce(F.lower(F.try_element_at(rest, F.lit(2))).isin(*ROAD_TYPES), F.lit(False)))
    d = d.withColumn("_w1", F.try_element_at(rest, F.lit(1)))
    d = d.withColumn("_two", F.array_join(F.slice(rest, 1, 2), " "))
    d = d.withColumn("_tail1", F.array_join(F.slice(rest, 2, F.greatest(n - 1, F.lit(1))), " "))
    d = d.withColumn("_tail2", F.array_join(F.slice(rest, 3, F.greatest(n - 2, F.lit(1))), " "))
    typ = F.col("_typ")
    valid = F.col("_num").isNotNull() & (n > 0)
    none = F.lit(None).cast("string")
    street1 = F.when(n == 1, F.col("_w1")).when(typ, F.col("_two")).otherwise(F.col("_w1"))
    city1 = (F.when(n == 1, none).when((n == 2) & typ, none).when(n == 2, F.try_element_at(rest, F.lit(2)))
             .when(typ, F.col("_tail2")).otherwise(F.col("_tail1")))
    retry = (n >= 3) & ~typ
    d = d.select("*", F.when(valid, F.col("_num")).alias(prefix + "number"),
                 F.when(valid, street1).alias(prefix + "street1"), F.when(valid, city1).alias(prefix + "city1"),
                 F.when(valid & retry, F.col("_two")).alias(prefix + "street2"),
                 F.when(valid & retry, F.col("_tail2")).alias(prefix + "city2"))
    return d.drop("_idx", "_num", "_rest", "_n", "_typ", "_w1", "_two", "_tail1", "_tail2")


def like_safe(p) -> Column:
    """User '%' and '_' stay wildcards; a backslash before an ordinary
    character is dropped (PostgreSQL reads it as that character, Spark raises).
    Escapes are consumed from the left, so an escaped backslash stays a pair."""
    return F.regexp_replace(_c(p), r"(?s)(\\[\\%_])|\\(.)", "$1$2")


def contains_ci(text, pattern) -> Column:
    """``text ILIKE '%' || pattern || '%'`` (null-propagating).

    Plain substring test when the pattern has no wildcard or escape, else ILIKE.
    """
    t, p = _c(text), _c(pattern)
    plain = ~p.rlike(r"[%_\\]")
    return F.when(plain, F.instr(F.lower(t), F.lower(p)) > 0).otherwise(
        F.ilike(t, F.concat(F.lit("%"), like_safe(p), F.lit("%"))))


def startswith_ci(text, pattern) -> Column:
    """``text ILIKE pattern || '%'``."""
    t, p = _c(text), _c(pattern)
    plain = ~p.rlike(r"[%_\\]")
    return F.when(plain, F.startswith(F.lower(t), F.lower(p))).otherwise(
        F.ilike(t, F.concat(like_safe(p), F.lit("%"))))


def initcap_key(c) -> Column:
    """H5: ``initcap(replace(x, '-', ' '))``."""
    return F.initcap(F.replace(_c(c), F.lit("-"), F.lit(" ")))


def norm_key(c) -> Column:
    """H6 / C4: ``lower(trim(x))`` join key."""
    return F.lower(F.trim(_c(c)))


def strip_suffix(c, suffix: str) -> Column:
    """Drop a trailing ' City' / ' Island'."""
    return F.regexp_replace(_c(c), " " + suffix + "$", "")


def place_query(*parts) -> Column:
    """H13: "{suburb}, {district}, New Zealand" (nulls skipped)."""
    return F.concat_ws(", ", *[_c(p) for p in parts], F.lit("New Zealand"))


def place_query_url(c) -> Column:
    """The place query as sent to a search endpoint (blanks and commas
    percent-encoded, the two characters the reference encodes)."""
    return F.replace(F.replace(_c(c), F.lit(" "), F.lit("%20")), F.lit(","), F.lit("%2C"))


def format_id(prefix: str, width: int, n) -> Column:
    """Ids like R01, D0001, S00001."""
    return F.format_string(f"{prefix}%0{width}d", _c(n).cast("int"))


# H4: word-bounded, case-sensitive replacement, longest short form first, each
# entry once and in this order, so a later entry also sees what earlier ones wrote.
ABBREVIATION_CATEGORIES = ("prefix", "location")


def abbreviation_entries(abbreviations: DataFrame, categories=ABBREVIATION_CATEGORIES) -> DataFrame:
    """Distinct entries as a struct ``e`` that sorts in order of application,
    with the pattern and replacement ready, and ``short``, ``long``."""
    short, long = F.col("short_form"), F.col("long_form")
    quoted = F.concat(F.lit(r"\b\Q"), F.replace(short, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    plain = F.replace(F.replace(long, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return (abbreviations.where(F.col("category").isin(*categories) & (F.length(short) > 0) & long.isNotNull())
            .select(F.struct((-F.length(short)).alias("order"), short.alias("short"), quoted.alias("pattern"),
                             plain.alias("by")).alias("e"), short.alias("short"), long.alias("long")).distinct())


def apply_entries(c, entries: Column) -> Column:
    """Apply a sorted array of entries one after the other."""
    return F.aggregate(entries, _c(c), lambda acc, e: F.regexp_replace(acc, e["pattern"], e["by"]))


def expand_abbreviations(c, abbreviations: DataFrame, categories=ABBREVIATION_CATEGORIES) -> Column:
    """H4 as a column for a handful of entries, read once and tried on every
    row. ``operators.abbreviations.with_expanded`` does the same by joins, for
    a dictionary of any size; the queries use that."""
    rows = sorted(r.e for r in abbreviation_entries(abbreviations, categories).collect())
    out = _c(c)
    for e in rows:
        out = F.regexp_replace(out, F.lit(e.pattern), F.lit(e.by))
    return out
