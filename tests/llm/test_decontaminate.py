"""Benchmark decontamination: masks by enumeration, overlaps against brute force."""

import math
import random
from itertools import combinations

import pytest
from addrgrid.llm import decontaminate

W, SHARE = decontaminate.WINDOW, decontaminate.MIN_SHARE


@pytest.mark.parametrize("n", range(5, 16))
def test_every_accepted_substitution_leaves_a_seed_whole(n):
    size = min(n, W)  # longer items: what lies outside one window may differ altogether
    for replaced in combinations(range(size), size - math.ceil(size * SHARE - 1e-9)):
        assert any(all(at + p not in replaced for p in mask) for mask in decontaminate.masks_of(n)
                   for at in range(size - max(mask))), (n, replaced)


def brute(doc, item):
    """(n_same, -start, n_window, n_item) of the best window over all diagonals."""
    size, best = min(len(item), W), None
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + j < len(doc) and doc[shift + j] == w for j, w in enumerate(item)]
        for at in range(len(item) - size + 1):
            n = sum(same[at:at + size])
            if n >= math.ceil(size * SHARE - 1e-9):
                best = max(best or (0,), (n, -(shift + at), size, len(item)))
    return best


def test_overlaps_like_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(60))
    items = [(n * 10 + k, [word() for _ in range(n)]) for n in range(1, 19) for k in range(3)]
    docs = []
    for i, (_, words) in enumerate(items * 8):
        size = min(len(words), W)
        at = rng.randrange(len(words) - size + 1)
        part = words[at:at + size]
        for p in rng.sample(range(size), min(size, rng.randrange(4))):
            part[p] = "other" + str(rng.randrange(9))
        docs.append((i, [word() for _ in range(rng.randrange(4))] + part + [word() for _ in range(rng.randrange(4))]))
    docs += [(9000, []), (9001, items[-1][1] * 3)]
    found = decontaminate.find_overlaps(
        spark.createDataFrame([(i, " ".join(w).title() if i % 2 else ", ".join(w)) for i, w in docs] + [(9002, None)],
                              "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(7000, None), (7001, "")], "item_id long, text string"),
        tolerant_words=5)
    got = {(r.doc_id, r.item_id): (r.n_same, -r.start, r.n_window, r.n_item) for r in found.collect()}
    want = {(d, i): b for d, dw in docs for i, iw in items if len(iw) >= 5 and (b := brute(dw, iw))}
    assert got == want
    assert {n for _, _, _, n in got.values()} == set(range(5, 19)) and any(n < w for n, _, w, _ in got.values())


def test_short_items_word_for_word_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "say red fox now"), (2, "say red cat now"), (None, "red fox")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "Red fox!")], "item_id long, text string")
    assert decontaminate.find_overlaps(docs, items).count() == 0
    assert {r.doc_id for r in decontaminate.find_overlaps(docs, items, min_words=1).collect()} == {1, None}
    assert decontaminate.find_overlaps(docs, items.limit(0)).count() == 0
    assert decontaminate.find_overlaps(docs.limit(0), items, min_words=1).count() == 0
