"""Abbreviation expansion with a dictionary table of any size (H4).

Every name meets only the entries that can apply to it. An entry matches at
word bounds, so the first word of its short form is a whole word of the name:
names and entries are joined on that word. An entry may also match what an
earlier entry wrote; entries that share a word with the long form of an earlier
one are reached over a closure of the dictionary with itself, whose depth is the
longest such chain. The entries found are applied inside the row in the
dictionary's order, so the result is that of trying every entry on every name,
and the plan does not depend on the number of entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage


def _words(c: str):
    """The words of a text; one empty word if there are none, so that entries
    of signs alone are tried on every text."""
    return F.array_distinct(F.concat(F.filter(F.split(c, r"\W+"), lambda w: w != ""), F.array(F.lit(""))))


def _first_word(c: str):
    return F.coalesce(F.get(F.filter(F.split(c, r"\W+"), lambda w: w != ""), F.lit(0)), F.lit(""))


def reachable_entries(entries: DataFrame) -> DataFrame:
    """(e, follower): later entries that may match what ``e`` or one of its
    followers wrote."""
    heads = entries.select(F.col("e").alias("follower"), F.col("long").alias("f_long"), _first_word("short").alias("word"))
    step = (entries.select("e", F.explode(_words("long")).alias("word")).where("word <> ''").join(heads, "word")
            .where(F.col("follower") > F.col("e")).select("e", "follower").distinct())
    step = cut_lineage(step)
    pairs, n = step, step.count()
    onward = step.select(F.col("e").alias("follower"), F.col("follower").alias("further"))
    while n:
        grown = cut_lineage(pairs.union(pairs.join(onward, "follower").select("e", F.col("further").alias("follower"))).distinct())
        now = grown.count()
        if now == n:
            break
        pairs, n = grown, now
    return pairs


def with_expanded(df: DataFrame, name: str, abbreviations: DataFrame, out: str = "expanded",
                  categories=text.ABBREVIATION_CATEGORIES) -> DataFrame:
    """``df`` with the column ``out``: ``name`` with its abbreviations expanded
    (null stays null). Each distinct name is expanded once."""
    entries = cut_lineage(text.abbreviation_entries(abbreviations, categories))
    names = df.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    heads = entries.select("e", _first_word("short").alias("word"))
    met = names.select("_name", F.explode(_words("_name")).alias("word")).join(heads, "word").select("_name", "e")
    # an entry only starts a chain if it matches the name itself
    met = met.where(F.col("_name").contains(F.col("e.short")))
    later = met.join(reachable_entries(entries), "e").select("_name", F.col("follower").alias("e"))
    found = met.union(later).groupBy("_name").agg(F.sort_array(F.collect_set("e")).alias("entries"))
    found = found.select("_name", text.apply_entries("_name", F.col("entries")).alias("_long"))
    return (df.join(found, F.col(name) == F.col("_name"), "left")
            .withColumn(out, F.coalesce("_long", name)).drop("_name", "_long"))
