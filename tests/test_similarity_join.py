"""Trigram similarity join against every pair compared in plain Python."""

import random
import re

import numpy as np

from addrgrid.operators import matching


def grams(text):
    return {("  " + w + " ")[i:i + 3] for w in re.split(r"[^a-z0-9]+", text) if w for i in range(len(w) + 1)}


def best(text, addresses, threshold=0.6):
    own, found = grams(text), []
    for i, full in addresses:
        other = grams(full.lower())
        if own and other:
            sim = np.float32(len(own & other) / len(own | other))
            if float(sim) > threshold:
                found.append((-sim, i))
    return min(found, default=None)


def test_like_brute_force_at_every_level(spark):
    rng = random.Random(5)
    words = ["rata", "tui", "hill", "mill", "harbour", "view", "street", "road", "lane", "beach", "north", "port", "lake"]
    addresses = [(i, f"{rng.randrange(1, 40)} {' '.join(rng.choices(words, k=4))}") for i in range(300)]
    addresses += [(900, addresses[3][1]), (901, None), (902, ""), (903, "--")]

    def spoiled(text):
        chars = list(text)
        for _ in range(rng.randrange(0, 7)):
            chars[rng.randrange(len(chars))] = rng.choice("abtu ")
        return "".join(chars)

    asked = sorted({spoiled(rng.choice(addresses[:300])[1]) for _ in range(200)} | {"zzqx 90001", "", "  ", addresses[3][1]})
    table = spark.createDataFrame(addresses, "address_id long, full_address_ascii string")
    got = matching.similarity_join(spark.createDataFrame([(t,) for t in asked], "norm string"), table,
                                   req_key="norm").collect()
    want = {t: best(t, [(i, a) for i, a in addresses if a]) for t in asked}
    assert {r.norm: (-np.float32(r.sim), r.address_id) for r in got} == {t: w for t, w in want.items() if w}
    sims = [r.sim for r in got]
    assert min(sims) < 0.75 < 0.9 < max(sims) and len(got) < len(asked)


def test_nobody_asks(spark):
    table = spark.createDataFrame([(1, "1 rata street")], "address_id long, full_address_ascii string")
    for asked in ([], [("--",)]):
        rows = spark.createDataFrame(asked, "norm string")
        assert matching.similarity_join(rows, table, req_key="norm").collect() == []
