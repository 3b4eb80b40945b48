"""Operator 12 against a plain version, in whole and in its parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrgrid.llm import suffix_dedup as sd
from addrgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(docs, length):
    bodies = [(doc, (text or "").encode()) for doc, text in docs]
    times = Counter(hashlib.md5(b[i:i + length]).digest() for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for doc, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[hashlib.md5(b[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(docs, 200)
    assert any(0 < r[2] < r[1] for r in expected)
    assert result(QUERIES["op12_suffix_dedup"](spark, SF)) == expected


def small_docs():
    rng = random.Random(8)
    base = "".join(rng.choice("abé ") for _ in range(900))
    docs = [(i, "".join(rng.choice("abc\0") for _ in range(rng.randrange(80))) + base[rng.randrange(600):][:rng.randrange(300)])
            for i in range(60)]
    return docs + [(None, None), (None, base), (200, base), (200, base), (201, ""), (202, "q" * 3000), (203, "xy" * 200),
                   (204, base[:100] + "Ω" * 30 + base[:100]), (205, "".join(rng.choice("pqrst") for _ in range(40_000)))]


@pytest.mark.parametrize("length", [8, 20, 33])
def test_nulls_copies_overlaps_and_many_shards(spark, length):
    docs = small_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn(
        "copies", F.lit(1)).repartition(3)
    expected = plain(docs, length)
    for shard_bytes in (1 << 22, 2000):
        assert result(sd.remove_repeats(df, length=length, shard_bytes=shard_bytes)) == expected, shard_bytes


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert result(sd.remove_repeats(df)) == []


def texts_of(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(700))
    return [bytes(rng.choice(b"abc") for _ in range(rng.randrange(90))) + base[rng.randrange(300):][:rng.randrange(400)]
            for _ in range(60)] + [b"a" * 500, b"", b"abab" * 100]


@pytest.mark.parametrize("length", [8, 9, 24, 200])
def test_shard_finds_every_repeat_and_anchors_lie_in_them(length):
    texts = texts_of(length)
    data, starts, valid, repeats, group = sd.sorted_shard(texts, length)
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    places, hashes = sd.anchors(data, valid, length)
    often = Counter(hashes.tolist())
    shared = {p for p, h in zip(places.tolist(), hashes.tolist()) if often[h] > 1}
    by_group = {}
    for t, s in zip(texts, starts.tolist()):
        for i in range(len(t) - length + 1):
            window = t[i:i + length]
            assert repeats[s + i] == (times[window] > 1)
            assert by_group.setdefault(window, group[s + i]) == group[s + i]
            if times[window] > 1:
                assert shared & set(range(s + i, s + i + length - sd.gram_of(length) + 1))
    assert len(set(by_group.values())) == len(by_group)


def test_suffix_order_is_that_of_sorted_suffixes():
    data, starts, _ = sd.laid_out(texts_of(4), 64)
    n = int(starts[-1])
    order = sd.suffix_array(data, n, 64)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(n), key=lambda p: (raw[p:p + 64], p))


def test_runs_are_merged_by_bisection():
    rng = np.random.default_rng(3)
    for _ in range(30):
        runs = []
        for _ in range(rng.integers(1, 7)):
            pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 6, (rng.integers(0, 20), 2))})
            runs.append((np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)))
        times = Counter(p for h, lo in runs for p in zip(h.tolist(), lo.tolist()))
        for (h, lo), met in zip(runs, sd.merged_runs(runs)):
            assert met.tolist() == [times[p] > 1 for p in zip(h.tolist(), lo.tolist())]
