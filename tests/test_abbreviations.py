"""Abbreviation expansion (H4) against one substitution after the other."""

import random
import re

from addrgrid.functions import text
from addrgrid.operators.abbreviations import with_expanded

SCHEMA = "short_form string, long_form string, category string"
ENTRIES = [("St", "Saint", "prefix"), ("Mt", "Mount", "prefix"), ("Mount Saint", "Mt St", "location"),
           ("Locality 7", "St Mt", "location"), ("a.b$", "x\\y$1", "prefix"), ("X Y", "Z", "prefix"),
           ("ABCD", "X", "prefix"), ("Rd", "Road", "suffix"), ("N", "North", "location"), ("Mtn", "Mt", "prefix")]


def plain(name, entries):
    if name is None:
        return None
    for short, long, kind in sorted(entries, key=lambda r: (-len(r[0]), r[0])):
        if kind in ("prefix", "location"):
            name = re.sub(r"\b" + re.escape(short) + r"\b", lambda m: long, name)
    return name


def test_order_chains_bounds_and_signs(spark):
    rng = random.Random(1)
    names = [None, "", "St Heliers", "Mt St John", "Mount Saint X", "Locality 7 St", "a.b$ a.b$c", "ABCD Y", "StMt Mt-St"]
    names += [" ".join(rng.choices(["St", "Mt", "Mtn", "N", "ABCD", "Y", "Mount", "Saint", "Locality", "7", "x"], k=4))
              for _ in range(60)]
    names += names[:5]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    ab = spark.createDataFrame(ENTRIES, SCHEMA)
    expected = {i: plain(n, ENTRIES) for i, n in enumerate(names)}
    assert {r.i: r.expanded for r in with_expanded(df, "name", ab).collect()} == expected
    assert {r.i: r.e for r in df.withColumn("e", text.expand_abbreviations("name", ab)).collect()} == expected


def test_fifty_thousand_entries(spark):
    entries = [(f"K{k}", f"K{k + 1} East" if k % 500 == 20 else f"Long{k}", "prefix") for k in range(10, 50_010)]
    ab = spark.createDataFrame(entries, SCHEMA).repartition(4)
    names = [f"K{k} K{k + 1} Road" for k in range(10, 4000, 37)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = with_expanded(df, "name", ab)
    small = with_expanded(df, "name", spark.createDataFrame(ENTRIES, SCHEMA))
    depth = [f._jdf.queryExecution().analyzed().toString().count("Project") for f in (found, small)]
    assert depth[0] == depth[1]
    by_word = {s: (s, lo) for s, lo, _ in entries}

    def follow(name):
        # a short form of the same length that comes later in the order also meets what was written
        for s in sorted(by_word, key=lambda s: (-len(s), s)):
            if s in name:
                name = re.sub(rf"\b{s}\b", by_word[s][1], name)
        return name
    some = names[:: len(names) // 8]
    got = {r.name: r.expanded for r in found.where(found.name.isin(some)).collect()}
    assert got == {n: follow(n) for n in some}


def test_empty_dictionary(spark):
    df = spark.createDataFrame([("St Ives",)], "name string")
    assert with_expanded(df, "name", spark.createDataFrame([], SCHEMA)).first().expanded == "St Ives"
