"""Guess costs against every segmentation, base spans against plain patterns."""

import hashlib
import random
import re
import time
from functools import lru_cache

from addrgrid.llm import secret_scan
from addrgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def options(price, value, at):
    """Segments from ``at`` on, read off the value without tables."""
    lower = value.lower()
    yield from (("word", e, p) for e, p in price._words(value, lower, at))
    yield from (("date", e, p) for e, p in price._dates(value, at))
    for unit in (1, 2, 3, 4):
        piece, end = value[at:at + unit], at + unit
        while len(piece) == unit and value.startswith(piece, end):
            end += unit
        if len(piece) == unit and end - at >= max(3, 2 * unit):
            yield "repeat", end, unit * 1.5 + secret_scan.log10((end - at) / unit)
    end = at + 1
    while end < len(value) and lower[end] in price.next_key.get(lower[end - 1], ()):
        end += 1
    if end - at >= 3:
        turns = sum(lower[k] != lower[k - 2] for k in range(at + 2, end))
        yield "walk", end, secret_scan.log10(47 * 6) + 0.5 * secret_scan.log10(end - at) + 0.2 * min(turns, 12)
    for step in (1, -1):
        end = at + 1
        while end < len(value) and ord(value[end]) - ord(value[end - 1]) == step:
            end += 1
        if end - at >= 3:
            yield "walk", end, 1.5 + secret_scan.log10(end - at)


def test_runs_read_from_tables_equal_runs_read_off_the_value():
    price, rng = secret_scan.GuessCost(), random.Random(4)
    for _ in range(400):
        value = "".join(rng.choice(["a", "b", "qwe", "123", "aa", "abab", "cba", "é", "İ", "P", "1999-1-2"]) for _ in range(rng.randrange(1, 9)))
        runs = price._runs(value, "".join(c.lower() if len(c.lower()) == 1 else c for c in value))
        if "İ" in value:
            continue
        for at in range(len(value)):
            expected = [o for o in options(price, value, at) if o[0] in ("repeat", "walk")]
            assert [(k, e, round(p, 9)) for k, e, p in runs(at)] == [(k, e, round(p, 9)) for k, e, p in expected]


def test_cost_is_the_least_of_all_segmentations():
    price, rng = secret_scan.GuessCost(), random.Random(5)
    for _ in range(150):
        value = "".join(rng.choice(["pass", "word", "qwe", "12", "aa", "x", "K", "-", "love", "99"]) for _ in range(rng.randrange(1, 6)))
        letter = price._alphabet(value)

        @lru_cache(None)
        def least(at, before):
            if at == len(value):
                return 0.0
            # a new segment pays the step; a brute character after a brute one does not
            ways = [letter + (secret_scan.STEP if before not in ("", "brute") else 0.0) + least(at + 1, "brute")]
            ways += [p + (secret_scan.STEP if before else 0.0) + least(e, k) for k, e, p in options(price, value, at)]
            return min(ways)
        cost, segments = price(value)
        assert cost >= least(0, "") - 1e-9
        assert cost <= least(0, "") + 0.61  # the programme keeps one way to each place, so at most two steps more
        assert [s[1] for s in segments] == [0, *[s[2] for s in segments][:-1]] and segments[-1][2] == len(value)


def test_very_long_values_take_time_in_proportion():
    price = secret_scan.GuessCost()
    for piece in ("a", "abc", "qwerty", "x9K-"):
        began = time.process_time()
        price(piece * (200_000 // len(piece)))
        assert time.process_time() - began < 60


def test_base_spans_of_the_query_and_prices(spark):
    found = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, SF).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, spans = doc.text or "", []
        spans += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        r = found[doc.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert len([c for c in r.guess_costs.split(",") if c]) == len([c for c in r.spans.split(",") if c])
    assert all((len(r.guess_costs) > 0) == (len(r.spans) > 0) for r in found.values())


def test_the_price_decides_between_values(spark):
    text = "pwd: aaaaaaaaaaaa pwd: passwordpassword pwd: qwertyuiop123 pwd: k7#Vz!q0Lm@2 pwd: 1999-01-02love"
    rows = [(1, text), (1, text), (2, "pwd: " + "ab" * 50_000)]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [text[s.start:s.end] for s in got[0].spans] == ["k7#Vz!q0Lm@2"] and got[0] == got[1] and got[2].n_guess == 0
