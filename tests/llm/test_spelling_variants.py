"""Operator 13 against a plain version."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from addrgrid.llm import spelling_variants as sv
from addrgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain(docs, drop=199):
    counts = Counter()
    for doc, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % drop == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    by_gap = {}  # words that are equal but for one place, or but for one letter more
    for w in n:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1:]), set()).add(w)
        for i in range(len(w) + 1):
            by_gap.setdefault((w[:i], w[i:]), set()).add(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for w in group:
            near[w] |= {v for v in group if v != w}
    # a shared gap of two words of one length may also come from shifting, so compare in full
    near = {w: {v for v in vs if distance_is_one(w, v)} for w, vs in near.items()}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows, key=lambda r: r[0])


def distance_is_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def result(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_query_equals_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(docs)
    assert any(r[1] for r in expected)
    assert result(QUERIES["op13_spelling_variants"](spark, SF)) == expected


def small_docs():
    rng = random.Random(5)
    long = "".join(rng.choice("acgt") for _ in range(3000))
    words = ["straße", "strasse", "strassen", "STRASSEN", "Übermut", "übermut", "ubermut", "abcdef", "abcdeg", "abcdeh",
             "abcde", "aaaaaa", "aaaaaaa", "aaaaaab", "bananas", "banana", "ananas", "x" * 64, "x" * 65, "x" * 66, long,
             long[:1500] + long[1501:], "q" + long]
    docs = [(i, " ".join(rng.choices(words, k=60)) + rng.choice([".", "-", "Δ", ""])) for i in range(30)]
    often = ["chainaaa"] * 5 + ["chainaab"] * 25 + ["chainabb"] * 125 + ["chainbbb"] * 625 + ["chbinbbb"] * 3125
    return docs + [(None, None), (None, "straße " * 5), (3, ""), docs[0], docs[0], (99, " ".join(often)), (100, "z" * 500_000)]


def test_symbols_nulls_repeats_long_words_and_chains(spark):
    docs = small_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn(
        "n", F.lit(7)).repartition(4)
    for drop in (199, 3):
        expected = plain(docs, drop)
        for symbols in (None, 1, 2, 20):
            assert result(sv.group_variants(df, drop_every=drop, symbols=symbols)) == expected, (drop, symbols)
    roots = {r[0]: r[2] for r in plain(docs)}
    assert roots["chainaaa"] == "chbinbbb"


def test_empty_table(spark):
    found = sv.group_variants(spark.createDataFrame([], "doc_id long, text string"), drop_every=199)
    assert tuple(found.columns) == COLUMNS and found.count() == 0


def test_neighbourhood_holds_every_one_edit_word():
    symbols = sv.letter_symbols(5)
    rng = random.Random(6)
    for _ in range(50):
        word = "".join(rng.choice("abcdeféü") for _ in range(rng.randrange(2, 9)))
        own, around = sv.neighbourhood([word], 5)
        for i in range(len(word)):
            for other in (word[:i] + word[i + 1:], word[:i] + rng.choice("xyzà") + word[i + 1:]):
                assert sv.neighbourhood([other], 5)[0][0] in around[0]
        assert own[0] in around[0] and symbols.max() < 5
